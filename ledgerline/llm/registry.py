"""The contract queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import ann, balls, bpe, innerproduct, licenses, mixing, overlap, pii, quality, sharding, simhash, trie, urls
from ledgerline.llm.common import own_columns, table

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of the law ``rows``."""
    out = sharding.interleave(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "source"]), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights 1, 2, 3 in turn with at most three epochs of a source."""
    out = mixing.mix(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "source"]))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scanned for license phrases and templates."""
    return licenses.scan(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])).drop("spans")


#: The templates as patterns over words with one space between: the same language, for SQL.
_TEMPLATE_SQL = {
    "apache-2.0": "licensed under the apache license (version )?2 0",
    "mit-notice": "(released )?(distributed )?under the (terms of the )?mit license",
    "gpl-3.0": "(this work is )?licensed under the gnu general public license (version )?3",
    "cc-by-nc-4.0": "licensed under (the )?(creative commons )?(attribution noncommercial )?cc by nc 4 0",
    "cc-by-4.0": "licensed under (the )?(creative commons )?cc by 4 0",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of ([^ ]+ ){0,6}and associated documentation files",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "copyright-notice": "copyright (c )?([^ ]+ ){0,8}all rights reserved",
}



def _as_pattern(template: str) -> str:
    """A template as a pattern over words with a space after each, for SQL."""
    out = ""
    for part in re.split(r"(<<[^>]*>>)", template):
        if part.startswith("<<any:"):
            out += f"([^ ]+ ){{0,{part[6:-2]}}}"
        elif part.startswith("<<"):
            out += "(" if part == "<<optional>>" else ")?"
        else:
            out += "".join(f"{w.decode()} " for w in licenses.words_of(part))
    return out.removesuffix(" ")


_TEMPLATE_SQL |= {label: _as_pattern(t) for label, t in licenses.LICENSES.items()}

OP4_SQL = """
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
lined AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM worded),
placed AS (
  SELECT *,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl,
    list_filter([{templates}], lambda x: x IS NOT NULL) AS extra
  FROM lined),
joined AS (
  SELECT *, list_concat(mit, apache, gpl) AS places,
    list_filter([CASE WHEN len(mit) > 0 THEN 'mit' END, CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END], lambda x: x IS NOT NULL) AS base
  FROM placed)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, extra))), ',') AS labels,
       CASE WHEN len(extra) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM joined
""".replace("{templates}", ", ".join(f"CASE WHEN regexp_matches(line, ' {p} ') THEN '{label}' END" for label, p in _TEMPLATE_SQL.items()))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    out = bpe.encode(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"]), tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    out = simhash.near_duplicates(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that aren't held out."""
    docs = own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    network = quality.fit(docs, own_columns(table(spark, sf_dir, "labels"), ["doc_id", "quality"]))
    out = quality.score(docs, network)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every hundredth vector among all others."""
    rows = own_columns(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"])
    return ann.search(rows, F.col("vec_id") % 100 == 0, 10)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values that were."""
    return pii.pseudonymise(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"]))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector with all others."""
    rows = own_columns(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"])
    return innerproduct.top_k(rows, F.col("vec_id") % 20 == 0, 20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

#: Rules of the url query: verdict, then host and path prefix.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules; urls that no rule fits aren't listed and so allowed."""
    out = urls.judge(own_columns(table(spark, sf_dir, "pages"), ["page_id", "url"]), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = """
WITH rules(verdict, key) AS (VALUES {rules}),
parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS n
  FROM pages),
fits AS (
  SELECT n, arg_min(key, (-length(key), key)) AS rule, arg_min(verdict, (-length(key), key)) AS verdict
  FROM parts JOIN rules
    ON ends_with('.' || host, '.' || split_part(key, '/', 1)) AND starts_with(path, substr(key, strpos(key, '/')))
  WHERE host <> '' GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
""".replace("{rules}", ", ".join(f"('{v}', '{k}')" for v, k in RULES))


#: CRC-32 by its definition: a table of 256 entries by eight shifts each, then one step a byte.
_CRC_SQL = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT,0,0,0,0,0,0,0]),
                          lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
checksums AS (
  SELECT h, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(0, len(h), 2), lambda k: ('0x' || h[k + 1:k + 2])::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table)
"""

OP1_SQL = f"""
WITH {_CRC_SQL},
docs AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, crc AS text_crc32,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src
  FROM documents JOIN checksums ON h = hex(encode(coalesce(text, '')))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('{sharding.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || text_crc32), doc_id, size) - 1 AS r,
         count(*) OVER (PARTITION BY src) AS n
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + ('0x' || left(md5('{sharding.SEED}|' || src), 8))::BIGINT / 4294967296.0::DOUBLE) / n, src, r) - 1 AS p,
         count(*) OVER () AS total
  FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * {SHARDS} // total)::INTEGER AS shard,
       (p - ((p * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

OP8_SQL = f"""
WITH RECURSIVE {_CRC_SQL},
docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, source,
         md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || crc) AS h2
  FROM documents JOIN checksums ON h = hex(encode(coalesce(text, '')))),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
         sum(sum(size)) OVER ()::DOUBLE AS total
  FROM docs GROUP BY source),
-- Clamp, share again, until no source is above its cap.
fill AS (
  SELECT 0 AS step, source, source_size, w, total, false AS full_, 0.0::DOUBLE AS level FROM sources
  UNION ALL
  SELECT step + 1, source, source_size, w, total, full_ OR lev * w > 3.0 * source_size, lev
  FROM (SELECT *, (total - coalesce(sum(CASE WHEN full_ THEN 3.0 * source_size END) OVER (), 0))
                  / nullif(sum(CASE WHEN NOT full_ THEN w END) OVER (), 0) AS lev,
               count(*) OVER () AS n FROM fill)
  WHERE step <= n),
goals AS (
  SELECT source, source_size, CASE WHEN full_ THEN 3.0 * source_size ELSE level * w END::DOUBLE AS target
  FROM fill WHERE step = (SELECT max(step) FROM fill)),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h2, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, round(target - whole * source_size)::BIGINT - before)))::BIGINT AS taken
FROM placed
"""


def op11_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    return overlap.similarity_groups(own_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"]))


#: Documents of equal sets are one class; labels are spread until nothing changes.
OP11_SQL = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) END AS s
  FROM worded),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN sha256(array_to_string(s, chr(10))) END AS c, s FROM sets),
classes AS (SELECT c, any_value(n) AS n, any_value(s) AS s, min(doc_id) AS least FROM named WHERE n > 0 GROUP BY c),
grams AS (SELECT least AS c, n, unnest(s) AS g FROM classes),
shared AS (
  SELECT a.c AS a, b.c AS b FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM shared UNION ALL SELECT b, a FROM shared),
reached(c, r) AS (
  SELECT a, a FROM both_ways
  UNION
  SELECT reached.c, both_ways.b FROM reached JOIN both_ways ON reached.r = both_ways.a),
tops AS (SELECT c, min(r) AS component_id FROM reached GROUP BY c)
SELECT named.doc_id, named.n::BIGINT AS n_shingles, coalesce(tops.component_id, classes.least, named.doc_id)::BIGINT AS component_id
FROM named LEFT JOIN classes USING (c) LEFT JOIN tops ON tops.c = classes.least
"""


def op12_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components with its cluster after ten rounds of k-means with eight centroids."""
    return balls.cluster(own_columns(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"]))


def _op12_sql() -> str:
    """Rounds written out one after the other."""
    near = "SELECT v.n, v.vec_id, v.x, arg_min(c.cluster, (list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), c.cluster)) AS cluster FROM v CROSS JOIN {c} c GROUP BY v.n, v.vec_id, v.x"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({balls.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {balls.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster, x FROM (SELECT x, sha256('{balls.SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {balls.CLUSTERS}))",
    ]
    for k in range(balls.ROUNDS):
        parts.append(f"a{k} AS MATERIALIZED ({near.format(c=f'c{k}')})")
        parts.append(
            f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT cluster, list((s - ((s % k + k) % k)) // k ORDER BY i) AS x "
            f"FROM (SELECT cluster, i, sum(e)::BIGINT AS s, count(*)::BIGINT AS k FROM (SELECT cluster, unnest(x) AS e, unnest(range(64)) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"
        )
    last = f"c{balls.ROUNDS}"
    parts.append(f"z AS MATERIALIZED ({near.format(c=last)})")
    parts.append(f"d AS MATERIALIZED (SELECT z.vec_id, z.cluster, list_sum(list_transform(range(1, 65), lambda i: (z.x[i] - c.x[i]) * (z.x[i] - c.x[i])))::BIGINT AS distance, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN {last} c USING (cluster))")
    return (
        "WITH "
        + ",\n".join(parts)
        + "\nSELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d"
    )


OP12_SQL = _op12_sql()


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations, with what its subtree adds up to."""
    turns = trie.numbered(own_columns(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"]))
    return trie.rollup(*trie.rebuilt(turns)).drop("key")


OP13_SQL = f"""
WITH {{crc}},
numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t) - 1 AS idx, t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, conv_id - conv_id % {trie.BLOCK} AS base, crc % {trie.OPENINGS} AS h
  FROM (SELECT DISTINCT conv_id FROM numbered) JOIN checksums ON checksums.h = hex(encode(conv_id::VARCHAR))),
rebuilt AS (
  SELECT c.conv_id, n.t, length(n.text) AS len, n.idx, 0 AS part FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.idx < c.h
  UNION ALL
  SELECT c.conv_id, n.t, length(n.text), n.idx, 1 FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.idx >= c.h),
paths AS (
  SELECT conv_id, len, row_number() OVER w AS depth, string_agg(t, '') OVER w AS p
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, idx)),
members AS (
  SELECT conv_id, len, depth, p FROM paths UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (
  SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS e
  FROM (SELECT conv_id, arg_max(p, depth) AS p FROM members GROUP BY conv_id) GROUP BY p),
nodes AS (
  SELECT p, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(len) AS saved,
         CASE WHEN p <> '' THEN left(p, length(p) - 32) END AS parent
  FROM members GROUP BY p),
kids AS (SELECT parent AS p, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (
  SELECT left(nodes.p, 32 * unnest(range(0, depth + 1))) AS p, saved, (n_children IS NULL)::INTEGER AS leaf FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT p, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM above GROUP BY p)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (p) LEFT JOIN kids USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes up ON up.p = nodes.parent
""".replace("{crc}", _CRC_SQL.replace("encode(coalesce(text, ''))) AS h FROM documents", "encode(conv_id::VARCHAR)) AS h FROM conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The contract queries by name."""
    return {
        "op1_sharding": op1_sharding,
        "op2_quality": op2_quality,
        "op3_ann": op3_ann,
        "op4_licenses": op4_licenses,
        "op5_bpe": op5_bpe,
        "op6_pii": op6_pii,
        "op7_topk": op7_topk,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_url_filter": op10_url_filter,
        "op11_overlap": op11_overlap,
        "op12_balls": op12_balls,
        "op13_trie": op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for those of them that SQL can express."""
    return {"op1_sharding": OP1_SQL, "op4_licenses": OP4_SQL, "op7_topk": OP7_SQL, "op8_mixing": OP8_SQL, "op10_url_filter": OP10_SQL, "op11_overlap": OP11_SQL, "op12_balls": OP12_SQL, "op13_trie": OP13_SQL}
