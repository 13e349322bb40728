"""Category dictionaries used by the text operators.

Fixed values: the words, patterns and class names below decide the results of
classification and are kept as they are, in their order of precedence.
"""

from __future__ import annotations

ROOM_WORDS: dict[str, list[str]] = {
    "living": ["客厅", "起居室", "家庭厅"],
    "bolcany": ["阳台", "露台"],
    "bed": ["卧室", "主卧", "次卧", "客卧", "主人房", "老人房", "孩房", "儿童房", "客房", "长辈房"],
    "wash": ["清洗间", "家务间", "家政间", "家政房", "家政区", "洗衣房", "洗衣区", "盥洗房", "盥洗室", "盥洗区"],
    "kitchen": ["厨房"],
    "canteen": ["餐厅"],
    "rest": ["卫生间", "主卫", "客卫", "次卫", "公卫", "洗手间", "厕所", "浴池", "浴室", "淋浴间"],
    "study": ["书房", "工作室"],
    "hall": ["玄关", "门厅", "走廊", "过道", "门廊", "走道"],
    "play": ["娱乐室", "休闲区", "茶室", "健身房", "游戏厅"],
    "court": ["庭院", "花园", "花池"],
    "others": [
        "垃圾房", "设备间", "壁橱", "衣帽间", "保姆房", "电梯", "楼梯", "避难间", "避难区", "前室",
        "化妆间", "储藏室", "储物间", "多功能房", "多功能间", "多功能室", "多功能厅",
    ],
}
ROOM_DEFAULT = "default"

LEGEND_WORDS: dict[str, list[str]] = {
    "照明设备": ["灯", "照明"],
    "开关插座": ["开关", "单开", "双开", "插座", "地插", "防溅盒", "总关"],
    "消防安全": [
        "火", "喷淋", "烟感", "感烟", "应急", "消防", "喷头", "门禁", "对讲", "报警", "监控", "红外",
        "求救", "紧急按钮", "疏散", "安全出口",
    ],
    "配电设备": ["电箱", "电表箱", "桥架", "线头", "电位", "接线盒", "电源", "布线箱", "收线孔"],
    "常见电器": [
        "浴霸", "凉霸", "热水器", "wifi", "WIFI", "无线", "传感器", "电话", "网络", "摄像机", "广播",
        "扬声器", "探测器", "洗衣机", "电视", "油烟机", "净水器", "冰箱", "微波炉", "机器人",
    ],
    "排水管道": ["水管", "排水", "热水", "冷水", "水流", "水道", "分水器", "立管"],
    "卫生设备": ["地漏", "存水弯", "集水井", "洗手盆", "马桶", "坐便"],
    "阀门附件": ["阀"],
    "通风设备": ["室内机", "风口", "百叶窗", "空调", "排气", "排风", "煤气", "燃气", "送风", "孔洞", "风机"],
    "暖通管道": ["风管"],
    "建筑材料": ["混凝土", "砖", "玻璃", "石材"],
    "建筑结构": ["柱", "梁", "墙", "门"],
    "结构符号": ["标注", "标高", "尺寸", "轴线", "剖切"],
    "其它": ["支架", "检修口"],
}
LEGEND_OTHERS = "others"

LEGEND_SUBJECTS: dict[str, list[str]] = {
    "电气类图例": ["照明设备", "开关插座", "配电设备", "常见电器"],
    "给排水类图例": ["排水管道", "卫生设备", "阀门附件"],
    "暖通空调类图例": ["通风设备", "暖通管道"],
    "消防安全类图例": ["消防安全"],
    "建筑结构类图例": ["建筑材料", "建筑结构", "结构符号"],
    "其它图例": ["其它"],
    "非图例标签": ["default"],
}

LAYER_PATTERNS: dict[str, str] = {
    "标注与文字说明": "标注|说明|文本|文字|尺寸|text|txt|dim",
    "轴线索引": "索引|线|高差|axis|line",
    "图框布局": "图框",
    "装饰": "surface|fin|完成面|装饰",
    "暖通管道": "孔洞|风口|hole|风管",
    "排水管道": "水|立管|雨水|pipe|地漏",
    "开关插座": "开关|单开|双开|插座|地插|防溅盒|总关|switch|socket|面板",
    "阀门附件": "阀|法兰",
    "墙柱": "wall|rail|beam|bridge|wood|colu|柱|墙|梁|栏|阳台|hral|balcony|漏台",
    "其它建筑结构": "stair|star|楼梯|洞口",
    "门窗相关": "door|gate|门|dor|D&W|wind|窗",
    "家具与洁具": "furn|家具|洁具|马桶|水槽|洗脸",
    "建筑材料": "混凝土|砖|玻璃|石材|钢筋",
    "照明设备": "灯|照明|lite|led|light|lamp|lantern|bulb",
    "配电设备": "电箱|电表箱|桥架|线头|电位|接线盒|电源|布线箱|收线孔|elec|cable|wire|变电|电气",
    "常见电器": (
        "浴霸|凉霸|热水器|wifi|WIFI|无线|传感器|电话|网络|摄像机|广播|扬声器|探测器|洗衣机|电视|油烟机|净水器|冰箱|微波炉|机器人"
    ),
    "通风设备": "室内机|百叶|空调|排气|排风|煤气|燃气|送风|风机",
    "消防安全": (
        "火|喷淋|烟感|感烟|应急|消防|喷头|门禁|对讲|报警|监控|红外|求救|紧急按钮|疏散|安全出口|安防"
    ),
    "辅助图层": "Defpoint|非打印|bound",
    "其它": "",
}

# A text with one of these is a note, not the name of a symbol.
NOTE_WORDS = ["注：", "图例", "图 例", "图 例", "说明", "说 明", "说 明", "居中", "备注"]

# Moves of unclassified names: target category, words, excluded word.
RECLASSIFY = [
    ("开关插座", ["面板", "控制模块"], None),
    ("消防安全", ["警报"], "进出口"),
]

CJK = "\u4e00-\u9fff"
CJK_WIDE = "\u4e00-\u9fff\u3400-\u4dbf\u4dc0-\u9fbb\uf900-\ufa2d"

# Vocabulary and n-gram hashing of the text models.
UNKNOWN, PADDING = "<UNK>", "<PAD>"
VOCAB_SIZE = 10000
PAD_SIZE = 32
HASH_A, HASH_B, HASH_BUCKETS = 14918087, 18408749, 250499
