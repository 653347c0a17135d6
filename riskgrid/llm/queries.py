"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskgrid.llm import toxicity
from riskgrid.llm.collocations import phrases
from riskgrid.llm.feistel import shard
from riskgrid.llm.language import identify, learn
from riskgrid.llm.mixing import mix
from riskgrid.llm.packing import pack
from riskgrid.llm.periodic import looped, periodic_runs
from riskgrid.llm.pigeonhole import near_duplicates
from riskgrid.llm.quality import score, train
from riskgrid.llm.shared import remainder, table
from riskgrid.llm.substrings import drop_repeated_windows
from riskgrid.llm.suffixes import drop_repeats
from riskgrid.llm.toccurrence import similar_sets
from riskgrid.llm.voronoi import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


@query()
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), tokenizer_path())


@query()
def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_feistel_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = learn(docs.where(remainder("doc_id", 5) != 0))
    return identify(docs, model).withColumn("held_out", remainder("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score")


@query()
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    machine = train(docs, table(spark, folder, "labels").where(remainder("doc_id", 3) != 1))
    return score(docs, machine).withColumn("held_out", remainder("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")


_SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


@query(f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND {_SOUND} AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id),
low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN low ON low.id = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
""")
def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))


@query(f"""
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings WHERE {_SOUND}),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM best WHERE rank <= 5
""")
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN twice USING (h)),
each AS (SELECT doc_id, words[i] AS word, i FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return drop_repeated_windows(table(spark, folder, "documents")).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query(r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) ON id = d.doc_id
""")
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_sets(table(spark, folder, "documents"), length=3, percent=90)
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, x, unnest(range(CAST(len(x) // 2 - 99 AS BIGINT))) AS i FROM b WHERE len(x) >= 200),
windows AS (SELECT doc_id, i, md5(substring(x, CAST(2 * i + 1 AS BIGINT), 200)) AS h FROM places),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
marked AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM later),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, k),
ends AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT e.doc_id, string_agg(substring(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head,
    max(z) AS tail, sum(z - a) AS removed, count(*) AS n
  FROM ends e JOIN b ON b.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT b.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substring(x, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM b LEFT JOIN kept ON kept.doc_id = b.doc_id
""")
def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = drop_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


_LOOPED = r"""
read AS (SELECT doc_id, crc32_h // 10 AS g, crc32_h % 10 AS last, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM (
  SELECT *, {crc} AS crc32_h FROM documents)),
placed AS (SELECT *, CASE WHEN len(ws) > 0 THEN g % len(ws) END AS a FROM read),
looped AS (SELECT *, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM placed),
w AS (
  SELECT doc_id, CASE WHEN last = 0 AND len(ws) > 0 THEN list_transform(range(len(ws)), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS words
  FROM looped),
"""
#: crc32 of a decimal number without a built-in: bit by bit over its bytes, the number's digits joined to a list first.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""


@query(
    "WITH "
    + _LOOPED.replace("{crc}", f"xor(4294967295, {_CRC})")
    + """
spots AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM spots x JOIN spots y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
streaks AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM streaks WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
    arg_min({'start': start, 'length': length, 'period': period}, {'a': -length, 'b': start, 'c': period}) AS best
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM spots ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
  CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM w LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
)
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = periodic_runs(docs.select("doc_id", looped(F.col("text"), seed).alias("text")))
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    rows = found.withColumn("best", F.get(best, F.lit(0)))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.less div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


@query(r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, unnest(list_concat(
    list_transform(range(1, len(words) + 1), lambda i: words[i:i]), list_transform(range(1, len(words)), lambda i: words[i:i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2]), list_transform(range(1, len(words) - 2), lambda i: words[i:i + 3]))) AS g FROM w),
counts AS (SELECT lang, g, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY lang, g),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT lang, g, f AS a FROM counts WHERE len(g) > 1 AND f >= 30),
cuts AS (SELECT c.*, unnest(range(1, len(g))) AS k FROM candidates c),
scored AS (
  SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM scored) WHERE place = 1),
inside AS (
  SELECT lang, a AS most, unnest(list_filter([g[1:2], g[2:3], g[3:4], g[1:3], g[2:4]], lambda x: len(x) > 1 AND len(x) < len(g))) AS part FROM candidates),
covered AS (SELECT lang, part, max(most) AS most FROM inside GROUP BY ALL),
left_over AS (
  SELECT s.*, array_to_string(g, ' ') AS phrase FROM lowest s LEFT JOIN covered c ON c.lang = s.lang AND c.part = s.g
  WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over) JOIN totals USING (lang) WHERE rank <= 2000
""")
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases(table(spark, folder, "documents"))


@query()
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    detector = toxicity.train(docs, table(spark, folder, "labels").where(remainder("doc_id", 3) != 1))
    return toxicity.score(docs, detector).withColumn("held_out", remainder("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")
