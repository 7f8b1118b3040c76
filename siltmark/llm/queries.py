"""The opN_ queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import _shared as S
from . import ann, fingerprint, idplanes, jaccard, mixing, packing, periodic, pstable, resample, substring, suffix, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word in a 13-word window that also starts in a document with a smaller doc_id goes."""
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS k FROM starts),
least_id AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS i FROM win JOIN least_id USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
marked AS (SELECT w.doc_id, w.i, w.w, g.i IS NOT NULL AS removed FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
agg AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
               coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT removed), '') AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg ON d.doc_id = agg.doc_id
"""


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by sources, weighing 1, 2, 3 in turn, takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query
def op5_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as byte planes and read back from the files."""
    root = S.shared_root(spark)
    manifest = S.materialised(idplanes.write_ids(table(spark, sf_dir, "documents"), f"{root}/ids", tokenizer_file()), f"{root}/manifest")
    return idplanes.read_ids(spark, f"{root}/ids", manifest)


@query
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives by the salvage reader."""
    root = S.shared_root(spark)
    files = S.materialised(warc.write_archives(table(spark, sf_dir, "pages"), f"{root}/warc"), f"{root}/manifest")
    rows = warc.read_archives(files, f"{root}/warc").filter("kind = 'record'")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1: 160 bits, five at a time.
ORACLE_SQL["op8_warc_round_trip"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, payload, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
bits AS (SELECT page_id, payload, payload_bytes, array_to_string(list_transform(range(1, 41), lambda i:
    list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
                 strpos('0123456789abcdef', substr(h, i, 1)))), '') AS b FROM hashed),
named AS (SELECT page_id, payload, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * (substr(b, 5 * i + 1, 1) = '1')::INT + 8 * (substr(b, 5 * i + 2, 1) = '1')::INT
        + 4 * (substr(b, 5 * i + 3, 1) = '1')::INT + 2 * (substr(b, 5 * i + 4, 1) = '1')::INT + (substr(b, 5 * i + 5, 1) = '1')::INT), 1)), '') AS payload_digest FROM bits),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first_id FROM named)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM last
"""


@query
def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch, its edited text's, and the likeness to the edit and to the next document."""
    return fingerprint.compare_versions(table(spark, sf_dir, "documents"))


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets are 75 % alike or more."""
    return jaccard.similar(table(spark, sf_dir, "documents"))


ORACLE_SQL["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS s FROM d WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + 4], ' ') AS k FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_sets AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT x, y FROM both_sets JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach(doc_id, other) AS (SELECT x, y FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
least_id AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least_id ON least_id.doc_id = d.doc_id
"""


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each byte in a 200-byte string that also starts elsewhere goes."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


#: Strings are told apart by their MD5, which keeps 200-byte strings of every position out of the grouping.
ORACLE_SQL["op4_suffix_array_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
sized AS (SELECT doc_id, t, octet_length(t) AS n FROM d),
starts AS (SELECT doc_id, t, unnest(range(1, n - 198)) AS s FROM sized WHERE n >= 200),
keyed AS (SELECT doc_id, s, md5(t[s:s + 199]) AS k FROM starts),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, s FROM keyed WHERE k IN (SELECT k FROM twice)),
gaps AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 AS joined FROM hit),
numbered AS (SELECT doc_id, s, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM gaps),
runs AS (SELECT doc_id, run, min(s) AS a, max(s) + 199 AS b FROM numbered GROUP BY doc_id, run),
totals AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id),
edges AS (SELECT doc_id, 1 + coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a - 1 AS b FROM runs
          UNION ALL SELECT r.doc_id, max(r.b) + 1, any_value(n) FROM runs r JOIN sized ON sized.doc_id = r.doc_id GROUP BY r.doc_id
          UNION ALL SELECT doc_id, 1, n FROM sized WHERE doc_id NOT IN (SELECT doc_id FROM runs)),
kept AS (SELECT e.doc_id, string_agg(CASE WHEN e.b >= e.a THEN hex(t[e.a:e.b]) ELSE '' END, '' ORDER BY e.a) AS h FROM edges e JOIN sized ON sized.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT sized.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM sized JOIN kept ON kept.doc_id = sized.doc_id LEFT JOIN totals ON totals.doc_id = sized.doc_id
"""


@query
def op10_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows found of each embedding whose vec_id is divisible by 100."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of every document's categories and whether it is rejected as toxic."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("rejected", "toxic")


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn toward the distribution of words in the benchmark."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), orders=1)


#: CRC-32 of a column of byte lists, with its table of 256 entries made from the polynomial.
CRC_SQL = r"""
crc_steps(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM crc_steps WHERE k = 8),
"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295::BIGINT)"

ORACLE_SQL["op13_importance_resampling"] = (
    "WITH RECURSIVE "
    + CRC_SQL
    + r"""
cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
aim AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
w AS (SELECT doc_id, unnest(ws) AS w FROM cut),
named AS (SELECT w, """
    + CRC_OF.format("w")
    + r""" % 10000 AS b FROM (SELECT DISTINCT w FROM w UNION SELECT w FROM aim), crc_table),
s AS (SELECT b, count(*) AS s FROM w JOIN named USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM aim JOIN named USING (w) GROUP BY b),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
weighed AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM w JOIN named USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || c.doc_id), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM cut c LEFT JOIN weighed ON weighed.doc_id = c.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * fit // 100 THEN r END AS rank FROM placed
"""
)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words of every document, a tenth of which get one planted."""
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.find_runs(docs, keep=["doc_id"]))


#: A stretch of six or more equal pairs is a row of equal six-word strings, so pairs are joined by those.
ORACLE_SQL["op12_periodic_runs"] = (
    "WITH RECURSIVE "
    + CRC_SQL
    + r"""
raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, """
    + CRC_OF.format("doc_id::VARCHAR")
    + r""" AS h FROM documents, crc_table),
place AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g FROM raw),
period AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM place),
edited AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE ws END AS ws FROM period),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM edited),
six AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 5)) AS i FROM edited)),
pairs AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM six a JOIN six b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS isle FROM pairs),
stretch AS (SELECT doc_id, p, min(i) AS s, min(i) + count(*) + 5 + p AS e FROM numbered GROUP BY doc_id, p, isle),
runs AS (SELECT doc_id, s, e, min(p) AS p FROM stretch WHERE e - s >= greatest(12, 2 * p) GROUP BY doc_id, s, e),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, e)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, p) AS r FROM runs),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, (e - s)::BIGINT AS length, p::BIGINT AS period, (1000 * (e - s) // p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM edited x LEFT JOIN agg ON agg.doc_id = x.doc_id LEFT JOIN best ON best.doc_id = x.doc_id AND r = 1 LEFT JOIN kept ON kept.doc_id = x.doc_id
"""
)


@query
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each embedding to others of its label with a cosine of 0.93 or more, and its component."""
    return pstable.similar(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op11_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (SELECT x, y FROM linked UNION SELECT r.vec_id, l.y FROM reach r JOIN linked l ON r.other = l.x),
low AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id),
deg AS (SELECT x AS vec_id, count(*) AS n FROM linked GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN deg ON deg.vec_id = e.vec_id LEFT JOIN low ON low.vec_id = e.vec_id
"""
