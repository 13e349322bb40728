"""The corpus queries over the driver tables, with their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planspark.llm import bpe, chat, decontaminate, exact_dedup, html_crf, langid, lines, lloyd, packing, repair, simhash, toxicity, urls
from planspark.llm.common import in_rows_of, sha256_hex, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Tokenizer files are parameters of the operators; the queries use the installed public ones.
TOKENIZER_FILE = "word_bpe_49k.json"
PIECES_FILE = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def held_out() -> Column:
    """Rows never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers

    return os.environ.get("PLANSPARK_TOKENIZER", public_tokenizers.path(TOKENIZER_FILE))


@query(
    "op1_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = exact_dedup.exact_dedup(docs)
    names = ["doc_id", "keep_id", "group_size", "kept"]
    known = found.where("digest is not null").select(*names, F.col("digest").alias("text_sha256"))
    # rows that dropped out of the refinement early have no full hash yet
    keys = ["doc_id", "points", "size", "prefix"]
    clean = exact_dedup.signatures(docs).select(*keys, sha256_hex(F.col("clean")).alias("text_sha256")).distinct()
    rest = in_rows_of(found.where("digest is null").select(*names, *keys[1:]), clean, keys)
    return known.unionByName(rest.select(*names, "text_sha256"))


_CONTROL = chat.CHAT.control


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in _CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


@query(
    "op4_chat_format",
    rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), 'start') AS prev FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(2 + length({_escaped_sql('role')}) + 3 + length({_escaped_sql('text')}) + 5) AS BIGINT) AS formatted_chars,
  bool_and(CASE prev WHEN 'start' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant'
           ELSE prev IN ('system', 'assistant') AND role = 'user' END)
    AND arg_max(role, turn) IN ('user', 'assistant') AS valid
FROM w GROUP BY conv_id
""",
)
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    chats = chat.format_chats(rows.unionByName(own))
    back = chats.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss",
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), ""),
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        ).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def pieces_path() -> str:
    import public_tokenizers

    return os.environ.get("PLANSPARK_PIECES", public_tokenizers.path(PIECES_FILE))


#: The rules that the URL query is held to.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


@query(
    "op9_url_filter",
    r"""
WITH r(r_host, r_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                              ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(v, length(r_host || r_path)) AS v
      FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
""",
)
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules, "page_id")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


_BREAKS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op7_decontaminate",
    f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BREAKS}') AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS k
      FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_BREAKS}') AS ws FROM benchmark) WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win
      FROM (SELECT item_id, k, ws, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM b)),
p AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
      FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i
            FROM d, (SELECT DISTINCT k FROM w) WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, k, item_id FROM p JOIN w USING (k, win)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join(names, ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op10_line_dedup",
    f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, first IS NOT NULL AND first <> doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    dropped = F.aggregate("_runs", F.lit(0).cast("long"), lambda s, r: s + r["length"])
    return done.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
        sha256_hex(F.col("_kept")).alias("kept_sha256"),
    )


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    chain = html_crf.train(pages.select("page_id", "html"))
    # the url rides in the id so that the text is made in one scan
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    found = html_crf.main_text(keyed, chain, "page")
    return found.select(
        "page.page_id", "page.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars")
    )


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    net = langid.fit(docs.where(third != 1))
    return langid.identify(docs, net).select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op3_token_packing")
def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.encode(docs, pieces_path(), wide=True), pieces=packing.most_pieces(docs))


def _crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in SQL; ``tbl`` is the table of the byte values."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    step = "xor(c >> 8, tbl[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}))"


_KIND = _crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _arc(cost: str, letter: str, state: int, line: str = "''") -> str:
    return f"{{'c': {cost} + w[{state}].c, 'a': '{letter}' || w[{state}].a, 'o': {line} || w[{state}].o}}"


def _ways(s: int) -> str:
    """The ways on from state ``s`` (from 1) at a row, as a list; a way that is shut has the cost 10^9."""
    kept = {1: (("s", 2), ("u", 3)), 2: (("u", 3),), 3: (("a", 4),), 4: (("u", 3),)}[s]
    to = (3, 3, 4, 3)[s - 1]
    said = {3: "user", 4: "assistant"}[to]
    ways = [_arc("4", "D", s)]
    for initial, t in kept:
        shut = f"CASE WHEN gone OR left(role, 1) <> '{initial}' THEN 1000000000 ELSE extra END"
        ways.append(_arc(shut, "K", t, "role || ':' || text || chr(10)"))
    ways.append(_arc("CASE WHEN gone THEN 1000000000 ELSE 3 + extra END", "R", to, f"'{said}:' || text || chr(10)"))
    return f"list_sort([{', '.join(ways)}])[1]"


def _after_inserts(s: int) -> str:
    """The least of ``b[s]`` and of one or two turns inserted before it."""
    to = (3, 3, 4, 3)[s - 1]
    two = {3: 4, 4: 3}[to]
    said = {3: "user:", 4: "assistant:"}
    first = f"{{'c': 3 + b[{to}].c, 'a': 'I' || b[{to}].a, 'o': '{said[to]}' || chr(10) || b[{to}].o}}"
    second = (
        f"{{'c': 6 + b[{two}].c, 'a': 'II' || b[{two}].a,"
        f" 'o': '{said[to]}' || chr(10) || '{said[two]}' || chr(10) || b[{two}].o}}"
    )
    return f"list_sort([b[{s}], {first}, {second}])[1]"


@query(
    "op12_conversation_repair",
    f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS tbl),
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM f WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
        lead(role) OVER (PARTITION BY conv_id ORDER BY pos) AS next, rtrim(text, {_WHITE}) AS t FROM p),
g AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated'
        ELSE '' END AS fault FROM q),
r AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM g),
s AS (SELECT conv_id, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (left(role, 1) || left(next, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v AS (
  SELECT conv_id, n + 1 AS pos, [{{'c': 0, 'a': '', 'o': ''}}, {{'c': 6, 'a': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}},
    {{'c': 3, 'a': 'I', 'o': 'assistant:' || chr(10)}}, {{'c': 0, 'a': '', 'o': ''}}] AS w FROM s
  UNION ALL
  SELECT conv_id, pos, [{', '.join(_after_inserts(s) for s in (1, 2, 3, 4))}] AS w
  FROM (SELECT v.conv_id, r.pos, [{', '.join(_ways(s) for s in (1, 2, 3, 4))}] AS b
        FROM v JOIN r ON v.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = v.pos - 1))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(w[1].c, 0) AS BIGINT) AS cost,
  coalesce(w[1].a, '') AS audit, sha256(coalesce(left(w[1].o, length(w[1].o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
LEFT JOIN v ON c.conv_id IS NOT DISTINCT FROM v.conv_id AND v.pos = 1
""",
)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(rows, *repair.repair(repair.damage(rows)))


def _lloyd_sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    whole = f"list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT))"
    odd = "len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, {whole} AS v FROM embeddings WHERE len(embedding) = {size} AND {odd} = 0)",
        f"e AS MATERIALIZED (SELECT vec_id, unnest(range({size})) AS d, unnest(v) AS x FROM kept)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {k})",
        "c0 AS MATERIALIZED (SELECT k, d, x AS c FROM first JOIN e USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"s{r} AS (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS q FROM e JOIN c{r} USING (d) GROUP BY vec_id, k)"
        )
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, k, q FROM s{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, k) = 1)"
        )
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT k, d, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{r} JOIN e USING (vec_id) GROUP BY k, d)"
            )
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT k, d, coalesce((t - ((t % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN m{r} USING (k, d))"
            )
    return f"""
WITH {", ".join(parts)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, q AS distance, CAST(sum(q) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(q) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (k)
"""


@query("op13_centroid_clusters", _lloyd_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return lloyd.with_inertia(*lloyd.cluster(vectors))
