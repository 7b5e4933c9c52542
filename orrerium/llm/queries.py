"""Queries over the whole tables, with production parameters, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerium.llm import chat, language, lm, quality, runs, search
from orrerium.llm.common import quiet_arrow, table
from orrerium.llm.decontaminate import decontaminate
from orrerium.llm.html import host, main_text
from orrerium.llm.near_vectors import near_vectors
from orrerium.llm.ngram_join import ngram_join
from orrerium.llm.packing import pack_documents
from orrerium.llm.repeats import remove_repeats
from orrerium.llm.warc import canonical, resolve


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary file: setting orrerium.tokenizer, or the public word-level BPE."""
    import public_tokenizers

    return spark.conf.get("orrerium.tokenizer", None) or public_tokenizers.path("word_bpe_49k.json")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def pieces_path(spark: SparkSession) -> str:
    """The subword vocabulary: setting orrerium.pieces, or the public one with byte fallback."""
    import public_tokenizers

    return spark.conf.get("orrerium.pieces", None) or public_tokenizers.path("piece_bpe_32k.model")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), pieces_path(spark))


def op4b_word_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op4 SQL can state: folds, counts and the base score."""
    return op4_lattice_lm(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("kept")


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a full response, two of which share a time, and as a revisit: at the time of its response, before it, soon
    after it or long after. Which validators a capture bears goes by its id, so that each of them decides some, and none others."""
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    day = F.concat(F.lit("day "), (k % 3).cast("string"))
    plain = {"content-type": F.lit("text/html"), "age": F.lit("0")}

    def headers(etag: Column, modified: Column, digest: Column, **more: Column) -> Column:
        named = {"etag": F.when(etag, tag), "last-modified": F.when(modified, day), "warc-payload-digest": F.when(digest, tag)} | {n.replace("_", "-"): v for n, v in more.items()}
        return F.map_filter(F.create_map(*[x for n, v in named.items() for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())

    full = pages.select(
        F.format_string("r%d", k).alias("record_id"), "url", (k - k % 2).alias("ts"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        headers(k % 5 != 0, k % 4 != 1, k % 7 != 0, **{n.replace("-", "_"): v for n, v in plain.items()}).alias("headers"), F.col("html").cast("binary").alias("body"),
    )
    when = F.when(k % 4 == 0, k - k % 2).when(k % 4 == 1, k - 1 - k * 13 % 1000).when(k % 4 == 2, k + 1 + k * 37 % 1000).otherwise(k + 10**6)
    again = pages.select(
        F.format_string("v%d", k).alias("record_id"), "url", when.alias("ts"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        headers(k % 3 == 0, k % 2 == 1, k % 9 < 5, content_type=F.lit("none"), age=k.cast("string")).alias("headers"), F.lit(None).cast("binary").alias("body"),
    )
    out = resolve(full.unionByName(again))
    return out.select("record_id", "canonical_url", "state", "source_id", F.octet_length("body").cast("long").alias("n_bytes"), F.md5("body").alias("body_md5"), F.col("headers")["content-type"].alias("content_type"), F.col("headers")["age"].alias("age"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return quality.score(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    docs = table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs))
    return out.select("doc_id", "text_lang", "language", "confidence", F.col("accepted").alias("kept"))


def op8b_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: their text, the language their markup declares, and their host; the text model is that of the documents."""
    quiet_arrow(spark, 2000)
    pages = table(spark, sf_dir, "pages")
    said = pages.select("page_id", "url", "html", F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]+)", 1).alias("declared"))
    rows = said.select("page_id", "declared", host(F.col("url")).alias("host"), F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ").alias("text"))
    return language.identify(rows, language.train(table(spark, sf_dir, "documents")), "declared", "host").select("page_id", "declared", "text_lang", "language", "confidence", "accepted")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return main_text(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    said = spark.sql("SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    blocks = chat.format_blocks(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(said))
    turns = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = blocks.select("conv_id", "block", "n_turns", F.array_join(turns, "").alias("turns"), chat.read_loss(F.col("formatted"), F.col("spans")).alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    whole = chat.join_blocks(read, "turns", "loss", sums=("chars",))
    return whole.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))


def op11b_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a document of its text and an image as large as the text is long, with a recording of what an assistant says."""
    size = F.char_length(F.coalesce("text", F.lit("")))
    name = F.concat_ws("/", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def part(kind: str, **fields: Column) -> Column:
        kinds = {"text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
        return F.struct(F.lit(kind).alias("type"), *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])

    inner = F.array(part("text", text=F.coalesce("text", F.lit(""))), part("image", ref=F.concat(name, F.lit(".png")), width=size, height=F.col("turn") + 1))
    document = part("document", ref=name, pages=F.ceil(size / 100)).withField("parts", inner)
    audio = part("audio", ref=F.concat(name, F.lit(".wav")), seconds=size / 16).withField("parts", F.slice(inner, 1, 0))
    parts = F.when(F.col("role") == "assistant", F.array(document, audio)).otherwise(F.array(document))
    blocks = chat.format_blocks(table(spark, sf_dir, "conversations").withColumn("parts", parts), parts="parts")
    read = blocks.select("conv_id", "block", "n_turns", "formatted", F.size("attachments").cast("long").alias("attached"), F.coalesce(F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]), F.lit(0)).alias("tokens"), F.array_join(F.transform("attachments", lambda x: F.concat(x["kind"], F.lit(" "), x["ref"], F.lit(" "), x["tokens"].cast("string"), F.lit("\n"))), "").alias("refs"))
    whole = chat.join_blocks(read, "formatted", "refs", sums=("attached", "tokens"))
    return whole.select("conv_id", "n_turns", F.col("attached").alias("n_attachments"), F.col("tokens").alias("expanded_tokens"), F.sha2(F.col("formatted").cast("binary"), 256).alias("formatted_sha256"), F.char_length("refs").cast("long").alias("refs_chars"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet_arrow(spark, 2000)
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document; a tenth of the documents, by their ids, repeat words from some place on."""
    quiet_arrow(spark, 2000)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")).alias("w"))
    docs = docs.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.col("w")[F.col("a") + i % F.col("p")])
    found = runs.find(docs.select("doc_id", F.coalesce(F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " "), "text").alias("text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-top["start"]).alias("start"), top["length"].alias("length"), (-top["period"]).alias("period"), F.floor(1000 * top["length"] / -top["period"]).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_vectors": op1_near_vectors,
        "op2_packing": op2_packing,
        "op3_repeats": op3_repeats,
        "op4_lattice_lm": op4_lattice_lm,
        "op4b_word_base": op4b_word_base,
        "op5_decontaminate": op5_decontaminate,
        "op6_warc_revisits": op6_warc_revisits,
        "op7_quality": op7_quality,
        "op8_language": op8_language,
        "op8b_language_pages": op8b_language_pages,
        "op9_main_text": op9_main_text,
        "op10_ngram_join": op10_ngram_join,
        "op11_chat": op11_chat,
        "op11b_content_parts": op11b_content_parts,
        "op12_search": op12_search,
        "op13_runs": op13_runs,
    }


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, label, [x / list_max([abs(y) FOR y IN e]) FOR x IN e] AS e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.b, vec_id)) AS component_id, vec_id <= coalesce(m.b, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

OP4B_SQL = r"""
WITH t AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
h AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: xor(c >> 8, t.v[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 1 AS held_out,
  list_concat([x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''], [' ']) AS w FROM documents, t),
k AS (SELECT doc_id, held_out, unnest(w) AS x FROM h), c AS (SELECT x, count(*) AS c FROM k WHERE NOT held_out GROUP BY x), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 6) AS base_score FROM k LEFT JOIN c USING (x), n GROUP BY doc_id, held_out, n
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP6_SQL = r"""
WITH p AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(u, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort([x FOR x IN string_split(regexp_extract(u, '\?(.*)$', 1), '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)')]), '&') AS query FROM p),
c AS (SELECT page_id, html, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM q),
k AS (SELECT *, page_id AS k, md5(coalesce(html, '')) AS tag, 'day ' || (page_id % 3) AS day FROM c),
r AS (SELECT 'r' || k AS record_id, canonical_url, k - k % 2 AS ts, html AS body, CASE WHEN k % 5 <> 0 THEN tag END AS e, CASE WHEN k % 4 <> 1 THEN day END AS m, CASE WHEN k % 7 <> 0 THEN tag END AS d FROM k WHERE html IS NOT NULL),
v AS (SELECT 'v' || k AS record_id, k, canonical_url, CASE k % 4 WHEN 0 THEN k - k % 2 WHEN 1 THEN k - 1 - k * 13 % 1000 WHEN 2 THEN k + 1 + k * 37 % 1000 ELSE k + 1000000 END AS ts,
  CASE WHEN k % 3 = 0 THEN tag END AS e, CASE WHEN k % 2 = 1 THEN day END AS m, CASE WHEN k % 9 < 5 THEN tag END AS d FROM k),
a AS (SELECT v.record_id, arg_max(r.record_id, {'ts': r.ts, 'id': r.record_id}) AS source_id FROM v JOIN r ON r.canonical_url = v.canonical_url AND r.ts < v.ts GROUP BY v.record_id),
j AS (SELECT v.*, r.record_id AS source_id, r.body, CASE WHEN r.record_id IS NULL THEN 'unmatched' WHEN v.e IS NOT NULL AND r.e IS NOT NULL THEN CASE WHEN v.e = r.e THEN 'resolved' ELSE 'mismatched' END
  WHEN v.m IS NOT NULL AND r.m IS NOT NULL THEN CASE WHEN v.m = r.m THEN 'resolved' ELSE 'mismatched' END WHEN v.d IS NOT NULL AND r.d IS NOT NULL THEN CASE WHEN v.d = r.d THEN 'resolved' ELSE 'mismatched' END ELSE 'unvalidated' END AS state
  FROM v LEFT JOIN a USING (record_id) LEFT JOIN r ON r.record_id = a.source_id)
SELECT record_id, canonical_url, state, source_id, CASE WHEN state = 'resolved' THEN CAST(strlen(body) AS BIGINT) END AS n_bytes, CASE WHEN state = 'resolved' THEN md5(body) END AS body_md5,
  CASE WHEN state = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN state = 'resolved' THEN CAST(k AS VARCHAR) END AS age FROM j
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""


_OP11_TURNS = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations {more}),
b AS (SELECT *, regexp_replace(text, '([<\[])(\\*)({rests})', '\1\\\2\3', 'g') AS body, regexp_replace(role, '([<\[])(\\*)({rests})', '\1\\\2\3', 'g') AS named FROM a),
c AS (SELECT *, CASE role WHEN 'system' THEN '[SYS]' WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[/INST]' ELSE '[ROLE]' || named || '[/ROLE]' END AS mark FROM b)
"""
_RESTS = r"s>|/s>|SYS\]|INST\]|/INST\]|ROLE\]|/ROLE\]|image>|audio>|document>|/document>"

OP11_SQL = _OP11_TURNS.format(rests=_RESTS, more="UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')") + r"""
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(mark) + length(body) + 4) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id
"""

OP11B_SQL = _OP11_TURNS.format(rests=_RESTS, more="") + r""",
d AS (SELECT *, mark || '<document>' || chr(10) || body || chr(10) || '<image>' || chr(10) || '</document>' || CASE WHEN role = 'assistant' THEN chr(10) || '<audio>' ELSE '' END || '</s>' AS whole,
  CAST(512 * ceil(length(text) / 100) AS BIGINT) AS doc, CAST(ceil(greatest(length(text), 1) / 14) * ceil(greatest(turn + 1, 1) / 14) AS BIGINT) AS image, CASE WHEN role = 'assistant' THEN CAST(ceil(length(text) / 16 * 25) AS BIGINT) END AS audio,
  'turn/' || conv_id || '/' || turn AS name FROM c),
e AS (SELECT *, 'document ' || name || ' ' || doc || chr(10) || 'image ' || name || '.png ' || image || CASE WHEN role = 'assistant' THEN chr(10) || 'audio ' || name || '.wav ' || audio ELSE '' END || chr(10) AS refs FROM d)
SELECT conv_id, count(*) AS n_turns, CAST(sum(CASE WHEN role = 'assistant' THEN 3 ELSE 2 END) AS BIGINT) AS n_attachments, CAST(sum(doc + image + coalesce(audio, 0)) AS BIGINT) AS expanded_tokens,
  sha256(string_agg(whole, '' ORDER BY turn NULLS FIRST, role, text)) AS formatted_sha256, CAST(length(string_agg(refs, '')) AS BIGINT) AS refs_chars FROM e GROUP BY conv_id
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS t FROM documents),
b AS (SELECT DISTINCT item_id, unnest([x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']) AS x FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
f AS (SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS x FROM d) GROUP BY ALL),
w AS (SELECT x, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT x, count(*) AS df FROM f GROUP BY x), s),
r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM b JOIN f USING (x) JOIN w USING (x), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_vectors": OP1_SQL, "op4b_word_base": OP4B_SQL, "op5_decontaminate": OP5_SQL, "op6_warc_revisits": OP6_SQL, "op10_ngram_join": OP10_SQL, "op11_chat": OP11_SQL, "op11b_content_parts": OP11B_SQL, "op12_search": OP12_SQL}
