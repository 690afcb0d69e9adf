"""The thin opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import read
from tracemill.llm.decontaminate import decontaminate
from tracemill.llm.jaccard import jaccard_components
from tracemill.llm.link_trust import LINK, judge_urls
from tracemill.llm.mixing import mix, taken_words
from tracemill.llm.neighbours import search
from tracemill.llm.perspectives import rotate
from tracemill.llm.pii import KINDS, find_spans, shown
from tracemill.llm.quality import score_quality
from tracemill.llm.sharding import assign_shards, with_slots
from tracemill.llm.spelling import spelling_variants
from tracemill.llm.token_count import count_tokens
from tracemill.llm.toxicity import score_toxicity
from tracemill.llm.yinyang import cluster


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


#: Metadata that documents are sharded by.
SHARD_DIMS = ["source", "lang", "n_chars"]


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_slots(assign_shards(read(spark, sf_dir, "documents"), SHARD_DIMS, shards=24))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Weights of sources in code point order, again and again.
MIX_WEIGHTS = [5.0, 2.0, 1.0]


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taken_words(*mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS, share=1.5, most=2.0))
    return found.select("doc_id", "size", "source_size", "target", "taken", "n_shards")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), length=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k:k + 9], ' ') AS words FROM bk),
ms AS (SELECT DISTINCT m FROM bw),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m),
hit AS (SELECT doc_id, p, m, item FROM (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS words FROM dp) JOIN bw USING (m, words)),
places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS place FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), length=5, percent=80).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS sh FROM k),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
FROM d JOIN reach ON reach.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def held_out():
    """The fold that labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """Ids and labels of the rows that may be learned from."""
    return labels.where(F.col(label).isNotNull() & ~held_out()).select("doc_id", label)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(read(spark, sf_dir, "documents"), learnable(read(spark, sf_dir, "labels"), "toxic"), threshold=0.5)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents"), disclosure=0.8, support=1, certainty=0.25)
    count = [F.size(F.expr(f"filter(base, s -> s.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *count, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), F.size("base").cast("long").alias("n_base"), F.size("spans").cast("long").alias("n_spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(read(spark, sf_dir, "documents"), learnable(read(spark, sf_dir, "labels"), "quality"), threshold=0.3)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return search(table, table.where("vec_id % 20 = 0"), k=20, recall=0.97)


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rotate(read(spark, sf_dir, "conversations"), context_roles=("system",))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "segment", F.size("messages").cast("long").alias("n_messages"), "rendered", mask.alias("mask"))


OP5_SQL = r"""
WITH said AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS k FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
carried AS (SELECT conv_id, role, arg_min(text, k) AS text, min(k) AS k FROM said WHERE role = 'system' GROUP BY conv_id, role),
last AS (SELECT conv_id, max(k) // 64 AS last FROM said GROUP BY conv_id),
later AS (SELECT conv_id, unnest(range(1, last + 1)) AS segment FROM last),
shown AS (SELECT conv_id, k // 64 AS segment, k, role, text FROM said UNION ALL
  SELECT c.conv_id, l.segment, c.k, c.role, c.text FROM carried c JOIN later l ON c.conv_id IS NOT DISTINCT FROM l.conv_id AND c.k < l.segment * 64),
seen AS (SELECT s.*, w.perspective, '<|' || CASE WHEN s.role = w.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system' ELSE 'user name=' || s.role END || '|>' || chr(10) AS head FROM shown s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
placed AS (SELECT *, coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM seen)
SELECT conv_id, perspective, segment, count(*) AS n_messages, string_agg(head || text || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CAST(begins AS BIGINT) || ':' || CAST(begins + length(text) AS BIGINT), ',' ORDER BY k) FILTER (WHERE role = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective, segment
"""


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), shortest=5, least=3, misspell=97, times=2)


def op12_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dims=64)


def _op12_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after another: assignments a0, a1, ... and centroids c0, c1, ..."""
    kept = """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
    parts = [kept, f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), e) - 1 AS c, e FROM v QUALIFY c < {k})"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, d.d AS distance, d.c AS c FROM (SELECT r, min({{'d': list_sum(list_transform(list_zip(v.e, c{i}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c{i}.c}}) AS d FROM v, c{i} GROUP BY r))""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, c{i}.e) AS e FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY k) AS e FROM
  (SELECT c, k, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM (SELECT a.c, unnest(v.e) AS x, unnest(range(64)) AS k FROM a{i} a JOIN v USING (r)) GROUP BY c, k) GROUP BY c) m USING (c))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} z USING (c)"""


OP12_SQL = _op12_sql()

#: (verdict, host/path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op13_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES, threshold=0.5).select("page_id", "host", "path", "rule", "verdict")


def _op13_sql() -> str:
    """Walks of up to 86 links, as 0.85 ** 86 is the first below 1e-6."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for v, r in URL_RULES)
    host = low.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")
    link = LINK.replace("'", "''")
    return rf"""
WITH RECURSIVE x AS MATERIALIZED (SELECT page_id, html, {host} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule, base, below) AS (VALUES {rules}),
fits AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT host, path FROM x) JOIN rules ON (host = base OR ends_with(host, '.' || base)) AND starts_with(path, below) GROUP BY host, path),
p AS MATERIALIZED (SELECT page_id, html, x.host, x.path, rule, verdict FROM x LEFT JOIN fits ON x.host = fits.host AND x.path = fits.path),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {low.format(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM p WHERE host <> '') WHERE src <> dst GROUP BY src, dst),
ways AS MATERIALIZED (SELECT 'allow' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS part FROM e UNION ALL SELECT 'block', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
seeds AS (SELECT kind, host, count(*) FILTER (verdict = kind) / count(*) AS weight FROM p, (VALUES ('allow'), ('block')) k(kind) WHERE host <> '' GROUP BY kind, host),
walk(k, kind, host, weight) AS (SELECT 0, kind, host, weight FROM seeds WHERE weight > 0 UNION ALL SELECT w.k + 1, w.kind, ways.b, 0.85 * sum(w.weight * ways.part) FROM walk w JOIN ways ON ways.kind = w.kind AND ways.a = w.host WHERE w.k < 86 GROUP BY w.k, w.kind, ways.b),
levels AS (SELECT host, coalesce(sum(weight) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(weight) FILTER (kind = 'block'), 0) AS distrust FROM walk GROUP BY host)
SELECT page_id, p.host, path, rule, coalesce(verdict, CASE WHEN distrust >= 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN levels ON p.host = levels.host"""


OP13_SQL = _op13_sql()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
