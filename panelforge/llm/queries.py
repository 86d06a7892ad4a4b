"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, collocations, decontaminate, exactdedup, jaccard, langid, linededup, pii, sharding, topk, warc, wavelet
from .common import table

SHARDS = 40
IDS_FILE, END_ID = "byte_bpe_50k.json", 2
BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def op10_bpe_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text by ranks, encoded and decoded; digests of both."""
    path, pattern = public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN
    decoded = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by the similarity of their 5-word shingles."""
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive, read back by byte ranges."""
    records = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark, with the place of its longest stretch."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_kk_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def held_out() -> Column:
    """Whether a document is kept from learning; one without doc_id is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by prototypes of those not held out."""
    docs = table(spark, sf_dir, "documents")
    judged = langid.identify(docs.select(F.col("doc_id").cast("long"), "text"), langid.learn(docs, ~held_out()))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as ids in wavelet shards, and what the files hold of each document."""
    manifest = wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(IDS_FILE), END_ID)
    return wavelet.read_shards(manifest)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line to drop, with the earliest line that it matches."""
    return linededup.find(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, longest=5, most=2000)


def op12_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of those with its text."""
    found = exactdedup.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_jaccard": op1_jaccard,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_kk_shards": op4_kk_shards,
    "op5_topk": op5_topk,
    "op6_langid": op6_langid,
    "op7_pii": op7_pii,
    "op8_wavelet_shards": op8_wavelet_shards,
    "op9_linededup": op9_linededup,
    "op10_bpe_monoid": op10_bpe_monoid,
    "op11_collocations": op11_collocations,
    "op12_digest_index": op12_digest_index,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE: dict[str, str] = {
    "op1_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
        n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g),
        t AS (SELECT doc_id, md5(unnest(g)) AS t FROM g),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM t AS a JOIN t AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM o JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT doc_id, any_value(n) AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = doc_id GROUP BY doc_id""",
    "op5_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
        SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op9_linededup": """
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL),
        i AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d),
        w AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, list_filter(regexp_split_to_array(lower(t[i]), '\\s+'), lambda x: x <> '') AS w FROM i),
        s AS (SELECT doc_id, line, len(w) AS n, w, md5(array_to_string(w, ' ')) AS h FROM w WHERE len(w) >= 3),
        f AS (SELECT h, min((doc_id, line)) AS first FROM s GROUP BY h),
        e AS (SELECT doc_id, line, first, 0 AS distance FROM s JOIN f USING (h) WHERE (doc_id, line) <> first),
        u AS (SELECT s.* FROM s JOIN f USING (h) WHERE (doc_id, line) = first AND n >= 8),
        k AS (SELECT doc_id, line, w, unnest(range(1, n + 1)) AS i FROM u),
        v AS (SELECT doc_id, line, i, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ')) AS h FROM k),
        m AS (SELECT a.doc_id, a.line, (b.doc_id, b.line) AS other FROM v AS a JOIN v AS b ON a.h = b.h AND a.i = b.i
              UNION ALL SELECT a.doc_id, a.line, (b.doc_id, b.line) FROM v AS a JOIN u AS b ON a.h = b.h
              UNION ALL SELECT b.doc_id, b.line, (a.doc_id, a.line) FROM v AS a JOIN u AS b ON a.h = b.h),
        x AS (SELECT doc_id, line, min(other) AS first FROM m WHERE other < (doc_id, line) GROUP BY ALL),
        y AS (SELECT * FROM e UNION ALL SELECT doc_id, line, first, 1 FROM x)
        SELECT doc_id, line, first[1] AS kept_doc_id, first[2] AS kept_line, distance FROM y""",
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) ELSE page_id END AS kept FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> kept THEN kept END AS refers_to
        FROM g""",
    "op11_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\v\\f\\r]')) AS p FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 6) AS r(k)),
        f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, g, string_split(g, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 100),
        s AS (SELECT lang, a AS f, unnest(list_transform(range(0, k * k), lambda x: CASE WHEN x // k + x % k + 1 <= k AND x % k + 1 BETWEEN 2 AND k - 1 THEN array_to_string(w[x // k + 1:x // k + x % k + 1], ' ') END)) AS g FROM c),
        x AS (SELECT lang, g, max(f) AS longer FROM s WHERE g IS NOT NULL GROUP BY ALL),
        d AS (SELECT c.* FROM c LEFT JOIN x USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
        u AS (SELECT *, unnest(range(1, k)) AS i FROM d),
        v AS (SELECT u.*, y.f AS l, z.f AS r, n.n, (1000::HUGEINT * a * n.n) // (y.f::HUGEINT * z.f) AS score FROM u
              JOIN f AS y ON y.lang = u.lang AND y.g = array_to_string(w[1:i], ' ') JOIN f AS z ON z.lang = u.lang AND z.g = array_to_string(w[i + 1:u.k], ' ') JOIN n ON n.lang = u.lang),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, i) AS o FROM v),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM b WHERE o = 1)
        SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000""",
    "op12_digest_index": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]', '', 'g')) AS h FROM documents),
        k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
    "op13_filter_audit": """
        WITH f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS w FROM documents),
        m AS (SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, m),
        o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o, [a.b, b.b, c.b, d.b, e.b] AS b FROM f AS a JOIN f AS b ON b.f <> a.f JOIN f AS c ON c.f NOT IN (a.f, b.f) JOIN f AS d ON d.f NOT IN (a.f, b.f, c.f) JOIN f AS e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        s AS (SELECT array_to_string(o, '') AS filter_order, k AS step, b[k] AS own, coalesce(list_sum(b[1:k - 1]), 0)::INTEGER AS before FROM o, range(1, 6) AS r(k)),
        x AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE m & before = 0 AND m & own = 0) AS kept, sum(n) FILTER (WHERE m & before = 0 AND m & own <> 0) AS removed,
                sum(n) FILTER (WHERE m & before <> 0 AND m & own <> 0) AS redundant, sum(n) FILTER (WHERE m = own) AS unique_fails,
                sum(good) FILTER (WHERE m & before = 0 AND m & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE m & before = 0 AND m & own <> 0) AS toxic_lost FROM c, s GROUP BY ALL),
        y AS (SELECT part, own, sum(removed) AS shapley FROM x GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
          CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
        FROM x JOIN y USING (part, own)""",
}
