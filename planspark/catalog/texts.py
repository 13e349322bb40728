"""String, dictionary and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from planspark.catalog.bindings import cte, table, view
from planspark.catalog.registry import query
from planspark.functions import dictionaries as D
from planspark.functions import text as T
from planspark.operators import metrics as M
from planspark.operators import texts as X
from planspark.session import cut


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_lit(w)})" for w in words) + ")"


def _first(column: str, words, default: str) -> str:
    whens = " ".join(f"WHEN {_any(column, ws)} THEN {_lit(c)}" for c, ws in words.items())
    return f"CASE {whens} ELSE {_lit(default)} END"


def _pattern(column: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({column}, {_lit('(?is)' + p)}) THEN {_lit(c)}" if p else f"WHEN true THEN {_lit(c)}"
        for c, p in D.LAYER_PATTERNS.items()
    )
    return f"CASE {whens} END"


def _subject(column: str) -> str:
    whens = " ".join(
        f"WHEN {column} = {_lit(c)} THEN {_lit(s)}" for s, cats in D.LEGEND_SUBJECTS.items() for c in cats
    )
    return f"CASE {whens} END"


LN = f"WITH {cte('legend_names')} "
TX = f"WITH {cte('texts')} "
_HEX_CJK = "\\x{4e00}-\\x{9fff}"
_HEX_WIDE = _HEX_CJK + "\\x{3400}-\\x{4dbf}\\x{4dc0}-\\x{9fbb}\\x{f900}-\\x{fa2d}"


@query("keep_cjk", LN + f"SELECT id, regexp_replace(text || ' 12 ' || vp, '[^{_HEX_CJK}]', '', 'g') AS kept FROM legend_names")
def keep_cjk(spark, d):
    mixed = F.concat(F.col("text"), F.lit(" 12 "), F.col("vp"))
    return view(spark, d, "legend_names").select("id", T.keep_cjk(mixed).alias("kept"))


@query(
    "text_len_filter",
    TX + f"SELECT id, text FROM texts WHERE length(regexp_replace(text, '[^{_HEX_CJK}]', '', 'g')) BETWEEN 2 AND 7",
)
def text_len_filter(spark, d):
    return view(spark, d, "texts").where(T.label_length_ok(F.col("text"))).select("id", "text")


@query("has_cjk", LN + f"SELECT id, regexp_matches(text, '[{_HEX_WIDE}]') AS cjk FROM legend_names")
def has_cjk(spark, d):
    return view(spark, d, "legend_names").select("id", T.has_cjk(F.col("text")).alias("cjk"))


@query(
    "is_legend_label",
    LN + f"""SELECT id, text, length(text) >= 2 AND NOT {_any('text', D.NOTE_WORDS)}
    AND regexp_matches(text, '[{_HEX_WIDE}]') AS accepted FROM legend_names""",
)
def is_legend_label(spark, d):
    return view(spark, d, "legend_names").select("id", "text", T.is_legend_label(F.col("text")).alias("accepted"))


@query(
    "legend_text_triage",
    f"""WITH {cte('legend_nodes')} SELECT dwg_id, id, CASE WHEN type = 'Text' AND regexp_matches(text, '[{_HEX_CJK}]')
    THEN 'label' WHEN type = 'Text' AND length(text) > 2 THEN 'drop' ELSE 'symbol' END AS role FROM legend_nodes""",
)
def legend_text_triage(spark, d):
    return view(spark, d, "legend_nodes").select(
        "dwg_id", "id", T.legend_role(F.col("type"), F.col("text")).alias("role")
    )


@query(
    "select_by_keywords",
    LN + """SELECT id, c AS category FROM (SELECT id, unnest(CASE WHEN a OR b THEN
      list_concat(CASE WHEN a THEN ['灯具'] ELSE [] END, CASE WHEN b THEN ['阀类'] ELSE [] END) ELSE ['default'] END) AS c
    FROM (SELECT id, contains(text, '灯') OR contains(text, '开关') AS a,
      (contains(text, '阀') OR contains(text, '水')) AND NOT contains(text, '热水') AS b FROM legend_names))""",
)
def select_by_keywords(spark, d):
    moves = [("灯具", ["灯", "开关"], None), ("阀类", ["阀", "水"], "热水")]
    return X.reclassify(view(spark, d, "legend_names"), "text", moves).select("id", "category")


@query(
    "dict_first_match",
    LN + f"SELECT id, {_first('text', D.LEGEND_WORDS, D.LEGEND_OTHERS)} AS category FROM legend_names",
)
def dict_first_match(spark, d):
    return view(spark, d, "legend_names").select(
        "id", T.first_category(F.col("text"), D.LEGEND_WORDS, D.LEGEND_OTHERS).alias("category")
    )


@query("dict_regex_first", f"SELECT doc_id, {_pattern('text')} AS layer FROM documents")
def dict_regex_first(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.first_pattern(F.col("text"), D.LAYER_PATTERNS).alias("layer")
    )


def _room_list(column: str) -> str:
    parts = ", ".join(f"CASE WHEN {_any(column, ws)} THEN '{c}' END" for c, ws in D.ROOM_WORDS.items())
    return f"list_filter([{parts}], lambda v: v IS NOT NULL)"


@query(
    "dict_multi_match",
    TX + f"""SELECT id, unnest(CASE WHEN len(f) > 0 THEN f ELSE ['default'] END) AS category
    FROM (SELECT id, {_room_list('text')} AS f FROM texts)""",
)
def dict_multi_match(spark, d):
    hits = T.all_categories(F.col("text"), D.ROOM_WORDS, D.ROOM_DEFAULT)
    return view(spark, d, "texts").select("id", F.explode(hits).alias("category"))


@query("room_functions_of_text", TX + f"SELECT id, array_to_string(f, '-') AS functions FROM (SELECT id, {_room_list('text')} AS f FROM texts) WHERE len(f) > 0")
def room_functions_of_text(spark, d):
    found = view(spark, d, "texts").select("id", T.room_functions(F.col("text")).alias("f"))
    return found.where(F.size("f") > 0).select("id", F.array_join("f", "-").alias("functions"))


@query(
    "catalog_lookup",
    LN + f""", k AS (SELECT id, {_first('text', D.LEGEND_WORDS, D.LEGEND_OTHERS)} AS category FROM legend_names)
    SELECT category, {_subject('category')} AS subject, count(*) AS n FROM k GROUP BY 1""",
)
def catalog_lookup(spark, d):
    named = view(spark, d, "legend_names").select(
        T.first_category(F.col("text"), D.LEGEND_WORDS, D.LEGEND_OTHERS).alias("category")
    )
    counted = named.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("subject", T.subject_of(F.col("category")))


@query(
    "catalog_gaps",
    LN + f""", k AS (SELECT DISTINCT {_first('text', D.LEGEND_WORDS, D.LEGEND_OTHERS)} AS category FROM legend_names),
    c AS (SELECT unnest([{', '.join(_lit(c) for cats in D.LEGEND_SUBJECTS.values() for c in cats)}]) AS category)
    SELECT category, 'class' AS side FROM k WHERE category NOT IN (SELECT category FROM c)
    UNION ALL SELECT category, 'catalog' FROM c WHERE category NOT IN (SELECT category FROM k)""",
)
def catalog_gaps(spark, d):
    named = view(spark, d, "legend_names").select(
        T.first_category(F.col("text"), D.LEGEND_WORDS, D.LEGEND_OTHERS).alias("category")
    )
    return X.catalog_gaps(named, X.subject_table(spark), "category")


_FILES = """WITH f AS (SELECT o_orderkey AS id, 'plan-' || (o_orderkey % 500) || '-' || (o_custkey % 7) || '-'
  || o_orderstatus AS name, 'plan_' || o_orderkey || '--&&&--vp-' || (o_custkey % 9) || '-model.json' AS path FROM orders) """


def files(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.expr("concat('plan-', o_orderkey % 500, '-', o_custkey % 7, '-', o_orderstatus)").alias("name"),
        F.expr("concat('plan_', o_orderkey, '--&&&--vp-', o_custkey % 9, '-model.json')").alias("path"),
    )


@query(
    "name_parse",
    _FILES + """SELECT id, regexp_extract(path, '--&&&--(.*)-model\\.json$', 1) AS vp,
    regexp_replace(name, '(-[^-]*){2}$', '') || '.dwg' AS dwg FROM f""",
)
def name_parse(spark, d):
    return files(spark, d).select(
        "id", T.viewport_of(F.col("path")).alias("vp"), T.drop_name_parts(F.col("name"), 2, ".dwg").alias("dwg")
    )


@query(
    "drawing_names_distinct",
    _FILES + "SELECT count(DISTINCT regexp_replace(name, '(-[^-]*){2}$', '')) AS n2, count(DISTINCT regexp_replace(name, '(-[^-]*){1}$', '')) AS n1 FROM f",
)
def drawing_names_distinct(spark, d):
    names = files(spark, d)
    two = names.select(T.drop_name_parts(F.col("name"), 2).alias("n")).distinct().agg(F.count("n").alias("n2"))
    one = names.select(T.drop_name_parts(F.col("name"), 1).alias("n")).distinct().agg(F.count("n").alias("n1"))
    return two.join(F.broadcast(one))


@query(
    "natural_sort",
    """SELECT p_partkey, row_number() OVER (ORDER BY lower(regexp_extract(p_brand, '^[^0-9]*')),
    CAST(regexp_extract(p_brand, '[0-9]+') AS INT), p_partkey) AS rn FROM part""",
)
def natural_sort(spark, d):
    from planspark.operators.ordering import ranked

    part = table(spark, d, "part").select("p_partkey", T.natural_key(F.col("p_brand")).alias("k"))
    return ranked(part, [], [F.col("k"), F.col("p_partkey")]).select("p_partkey", "rn")


@query(
    "type_fanout",
    """WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Door,Window' WHEN 1 THEN 'Wall'
    WHEN 2 THEN 'Area,Door' WHEN 3 THEN 'Roof,Wall' ELSE 'Roof' END AS tt FROM orders)
    SELECT id, unnest(CASE WHEN list_contains(string_split(tt, ','), 'Area') THEN ['Area'] ELSE
      list_filter(string_split(tt, ','), lambda x: x IN ('Door', 'Window', 'Wall')) END) AS job FROM t""",
)
def type_fanout(spark, d):
    kinds = F.expr(
        "CASE o_orderkey % 5 WHEN 0 THEN 'Door,Window' WHEN 1 THEN 'Wall' WHEN 2 THEN 'Area,Door'"
        " WHEN 3 THEN 'Roof,Wall' ELSE 'Roof' END"
    )
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.explode(T.type_fanout(kinds)).alias("job")
    )


@query(
    "label_join",
    TX + f"SELECT id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE ['default'] END, '-') AS label FROM (SELECT id, {_room_list('text')} AS f FROM texts)",
)
def label_join(spark, d):
    hits = T.all_categories(F.col("text"), D.ROOM_WORDS, D.ROOM_DEFAULT)
    return view(spark, d, "texts").select("id", F.array_join(hits, "-").alias("label"))


@query("col_base64", "SELECT doc_id, base64(encode(text)) AS b64, text AS back FROM documents")
def col_base64(spark, d):
    code = T.to_base64(F.col("text").cast("binary"), "data:text/plain;base64,")
    docs = table(spark, d, "documents").select("doc_id", code.alias("u"))
    return docs.select(
        "doc_id",
        F.regexp_replace("u", "^data:[^,]*,", "").alias("b64"),
        T.from_base64(F.col("u")).cast("string").alias("back"),
    )


_LINES = "lines AS (SELECT trim(unnest(string_split(text, chr(10)))) AS text FROM documents)"


@query(
    "vocab_topk",
    f"""WITH {_LINES}, c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS token FROM lines),
    k AS (SELECT token, count(*) AS count FROM c GROUP BY 1),
    t AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) - 1 AS id FROM k QUALIFY id < 10000)
    SELECT token, count, id FROM t UNION ALL SELECT '<UNK>', NULL, count(*) FROM t
    UNION ALL SELECT '<PAD>', NULL, count(*) + 1 FROM t""",
)
def vocab_topk(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    return X.vocabulary(lines.select(F.trim("text").alias("text")))


_VOCAB = """c AS (SELECT unnest(string_split(text, ' ')) AS token FROM benchmark),
  k AS (SELECT token, count(*) AS count FROM c GROUP BY 1),
  t AS (SELECT token, row_number() OVER (ORDER BY count DESC, token) - 1 AS id FROM k QUALIFY id < 10000),
  unk AS (SELECT count(*) AS u FROM t), w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
  p AS (SELECT doc_id, least(len(ws), 32) AS seq_len, unnest(range(32)) AS pos,
    unnest(list_resize(ws[1:32], 32, '<PAD>')) AS token FROM w),
  ids AS (SELECT doc_id, seq_len, pos, CASE WHEN p.token = '<PAD>' THEN u + 1 ELSE coalesce(t.id, u) END AS tid
    FROM p CROSS JOIN unk LEFT JOIN t ON t.token = p.token)"""


def _ids(spark, d):
    vocab = X.vocabulary(table(spark, d, "benchmark"), by_word=True)
    return X.token_ids(table(spark, d, "documents"), vocab, "doc_id", by_word=True)


@query("tokenize_pad", f"WITH {_VOCAB} SELECT doc_id, seq_len, pos, tid FROM ids")
def tokenize_pad(spark, d):
    return _ids(spark, d).select("doc_id", "seq_len", F.posexplode("ids").alias("pos", "tid"))


@query(
    "ngram_hash",
    f"""WITH {_VOCAB}, l AS (SELECT *, coalesce(lag(tid, 1) OVER w, 0) AS t1, coalesce(lag(tid, 2) OVER w, 0) AS t2
    FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos, CAST(t1 * 14918087 % 250499 AS BIGINT) AS bigram,
      CAST((t2 * 14918087 * 18408749 + t1 * 14918087) % 250499 AS BIGINT) AS trigram FROM l""",
)
def ngram_hash(spark, d):
    bigram, trigram = T.ngram_hashes(F.col("ids"))
    hashed = _ids(spark, d).select("doc_id", F.arrays_zip(bigram.alias("bigram"), trigram.alias("trigram")).alias("z"))
    return hashed.select("doc_id", F.posexplode("z").alias("pos", "z")).select("doc_id", "pos", "z.*")


@query(
    "viewport_code",
    """WITH f AS (SELECT o_orderkey AS id, (o_orderkey % 2) || '' || (o_custkey % 2) || '' || (o_custkey // 2 % 2)
    || '' || (o_custkey // 4 % 2) || '' || (o_orderkey // 2 % 2) AS code FROM orders)
    SELECT id, code, substring(code, 5, 1) AS flag FROM f""",
)
def viewport_code(spark, d):
    o = table(spark, d, "orders")
    code = F.expr("concat(o_orderkey % 2, o_custkey % 2, o_custkey div 2 % 2, o_custkey div 4 % 2, o_orderkey div 2 % 2)")
    return o.select(F.col("o_orderkey").alias("id"), code.alias("code"), F.substring(code, 5, 1).alias("flag"))


@query("text_classifier")
def text_classifier(spark, d):
    """Quality labels predicted from whole texts: fitted on the train part, reported on the test part."""
    from planspark.operators.datasets import THREE_WAY, split_exact

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label")
    )
    parts = cut(split_exact(rows, "doc_id", THREE_WAY))
    model = X.text_classifier(parts.where("split = 'train'"), features=1 << 12, max_iter=10)
    scored = X.classify(model, parts.where("split = 'test'"))
    return M.classification_report(M.confusion_counts(scored, "label", "prediction"))


@query(
    "src_dictionary",
    f"""WITH {_LINES}, w AS (SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    h AS (SELECT *, CASE WHEN contains(line, '. ') THEN split_part(line, '. ', 1) END AS head FROM w),
    r AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h)
    SELECT doc_id, pos, section, split_part(line, ', ', 1) AS key, len(string_split(line, ', ')) - 1 AS n
    FROM r WHERE contains(line, ', ')""",
)
def src_dictionary(spark, d):
    """Key/value lines under running section headers, over the lines of every document."""
    from planspark.sources.dictionaries import keyed_lines

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = keyed_lines(lines, ["doc_id"], "pos", section_mark=". ", section_part=1, key_mark=", ", value_mark=", ")
    return keyed.select("doc_id", "pos", "section", "key", (F.size("values")).alias("n"))


@query(
    "running_section",
    """WITH w AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS head FROM conversations)
    SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM w""",
)
def running_section(spark, d):
    from planspark.operators.ordering import carried_header

    rows = table(spark, d, "conversations")
    head = F.when(F.col("role") == "user", F.col("text"))
    return carried_header(rows, ["conv_id"], [F.col("turn")], head, "section").select("conv_id", "turn", "section")
