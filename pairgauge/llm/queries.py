"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chunks,
    collocations,
    forest,
    katz,
    licenses,
    minhash,
    mixing,
    orderhash,
    packing,
    pieces,
    pii,
    resampling,
    toxicity,
)
from .common import read

HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 4 = 2"


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.cosine_classes(read(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    sha = F.sha2(F.col("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha, "spans")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.fingerprints(read(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2)
    return classes.drop("row_key")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(read(spark, sf_dir, "documents")).drop("row")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False
    )
    return pieces.drop("ids")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = F.expr("crc32(CAST(doc_id AS STRING)) % 5 <> 1")
    scored = katz.katz_scores(read(spark, sf_dir, "documents"), learned)
    return scored.withColumn("held_out", ~F.col("train")).drop("train")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(f"NOT ({HELD_OUT})"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        F.expr(HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "toxic_words",
        F.to_json("spans").alias("spans"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_forest": op1_forest,
    "op2_pii": op2_pii,
    "op3_order_minhash": op3_order_minhash,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_substrings": op6_substrings,
    "op7_licenses": op7_licenses,
    "op8_katz": op8_katz,
    "op9_mixing": op9_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_pieces": op12_pieces,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

_SHINGLES = """
    w AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+')
              IF x <> ''] AS ws FROM documents),
    p AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
              ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS c FROM p GROUP BY doc_id)"""

#: All pairs that share a shingle; fine for the small tables on which it is compared.
MINHASH_SQL = f"""
WITH RECURSIVE {_SHINGLES},
    s AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM p a JOIN p b USING (g)
          WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    e AS (SELECT x, y FROM s JOIN n AS k ON k.doc_id = x JOIN n AS l ON l.doc_id = y
          WHERE 100 * i >= 80 * (k.c + l.c - i)),
    r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
    m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(c, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM m LEFT JOIN n USING (doc_id)
"""

_LOWERED = """translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

#: CRC-32 over the bytes of each distinct word; the table of 256 entries follows from the polynomial.
RESAMPLING_SQL = f"""
WITH t AS MATERIALIZED (SELECT [list_reduce(list_prepend(i, range(8)), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS crc),
    dw AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
           FROM documents),
    bw AS (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
           FROM benchmark),
    known AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
    bytes AS (SELECT w, [(instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16
                  + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 FOR i IN range(len(h) // 2)]::BIGINT[] AS b
              FROM known),
    hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x:
                   xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, t),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY 1),
    g AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY 1),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
                 / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
             FROM s FULL JOIN g USING (bucket)),
    weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight
                FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
    noise AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, [instr('0123456789abcdef', c) - 1
                  FOR c IN string_split(left(sha256('2024:' || doc_id), 8), '')]::BIGINT[]),
                  lambda a, x: a * 16 + x) AS h FROM documents),
    scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                   + floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
               FROM noise LEFT JOIN weighed USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS c
               FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * c // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

#: Every phrase of up to four words is counted by itself.
COLLOCATIONS_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\n-\r]')) AS p
           FROM documents),
    q AS (SELECT lang, row_number() OVER () AS piece, [x FOR x IN string_split_regex(p, '[ \t]+') IF x <> ''] AS w
          FROM p),
    w AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM q),
    v AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4
          FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
    g AS (SELECT lang, 1 AS size, w1 AS phrase FROM v
          UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM v WHERE w2 IS NOT NULL
          UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM v WHERE w3 IS NOT NULL
          UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM v WHERE w4 IS NOT NULL),
    f AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY ALL
                       HAVING count(*) >= 30),
    total AS (SELECT lang, count(*) AS n FROM v GROUP BY 1),
    cut AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
            FROM f AS c JOIN range(1, 4) AS q(k) ON k < c.size
            JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
            JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
    best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_ AS (SELECT lang, a, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, size - s + 2)]) AS phrase
               FROM f JOIN range(2, 4) AS q(s) ON s < size),
    longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
    ranked AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
               FROM best AS b LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash": MINHASH_SQL,
    "op11_resampling": RESAMPLING_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
