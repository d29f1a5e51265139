"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokenizer() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import detect

    return detect(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_ordinal import select

    return select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_prefix import encode

    return encode(table(spark, sf_dir, "documents"), _tokenizer())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets_markov import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_fingerprint import edits

    return edits(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .icws_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid_ppm import identify

    return identify(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_reputation import judge

    return judge(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity_gbt import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle_manifest import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .product_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_pii that SQL can state."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_secrets that SQL can state."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5_fingerprints that SQL can state."""
    return op5_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_url_filter that SQL can state; verdict where a rule decides."""
    return op8_url_filter(spark, sf_dir).selectExpr("page_id", "host", "path", "rule", "CASE WHEN rule IS NOT NULL THEN verdict END AS verdict")


def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands and the verified Jaccard similarity of the fingerprint operator: documents whose id is divisible by 50 against all."""
    from .minhash_fingerprint import search

    docs = table(spark, sf_dir, "documents")
    return search(docs.where("doc_id % 50 = 0"), docs)


_TEXT = "doc_id, coalesce(text, '') AS t FROM documents"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format
_LEAF = "sha256(" + " || ".join(map(_FIELD, ("doc_id", "source", "lang", "{0}", "text"))) + ")"
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""
_PAIRS = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"
_STEP = "CASE WHEN nodes[xor({0} >> level, 1) + 1] IS NULL THEN '-' ELSE ['R', 'L'][({0} >> level) % 2 + 1] || nodes[xor({0} >> level, 1) + 1] END".format

_MERKLE = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('+' || lang, '') AS k, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS forged, n_chars IS NOT NULL AND {_CRC} % 7 = 0 AS chosen FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
lv(k, level, nodes) AS (SELECT k, 0, list(leaf ORDER BY pos) FROM p GROUP BY k UNION ALL SELECT k, level + 1, {_PAIRS} FROM lv WHERE len(nodes) > 1),
sub AS (SELECT k, nodes[1] AS subroot, row_number() OVER (ORDER BY k) - 1 AS place FROM lv WHERE len(nodes) = 1),
up(level, nodes) AS (SELECT 0, list(subroot ORDER BY place) FROM sub UNION ALL SELECT level + 1, {_PAIRS} FROM up WHERE len(nodes) > 1),
s AS (SELECT k, pos, level, {_STEP("pos")} AS step FROM p JOIN lv USING (k) WHERE len(nodes) > 1
      UNION ALL SELECT k, pos, level + 1000, {_STEP("place")} FROM p JOIN sub USING (k), up WHERE len(nodes) > 1),
proof AS (SELECT k, pos, list(step ORDER BY level) AS steps FROM s GROUP BY k, pos),
f AS (SELECT doc_id, leaf, subroot, (SELECT nodes[1] FROM up WHERE len(nodes) = 1) AS root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
             list_reduce(list_prepend(CASE WHEN chosen THEN forged ELSE leaf END, coalesce(steps, [])),
                         lambda d, x: CASE x[1] WHEN '-' THEN sha256(d) WHEN 'R' THEN sha256(d || x[2:]) ELSE sha256(x[2:] || d) END) AS folded_root
      FROM p JOIN sub USING (k) LEFT JOIN proof USING (k, pos))
SELECT *, folded_root = root AS verified FROM f"""

_REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
word AS (SELECT rid, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""


def _codes(rounds: int = 6) -> str:
    """SQL of the vector codes: the rounds one after another."""
    nearest = """a{0} AS (SELECT rid, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT rid, b.p, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) AS d
    FROM b JOIN c{0} USING (p)) GROUP BY rid, p)""".format
    move = """g{0} AS (SELECT p, m.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{0} JOIN b USING (rid, p), (SELECT unnest(range(1, max(w) + 1)) AS i FROM v) GROUP BY p, m.e, i),
m{0} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM g{0} GROUP BY p, e),
c{1} AS (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{0} o LEFT JOIN m{0} m USING (p, e))""".format
    steps = [s for r in range(rounds) for s in (nearest(r), move(r, r + 1))]
    return ",\n".join(
        [
            """WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, len(embedding) // 8 AS w, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            "b AS (SELECT rid, p, x[p * w + 1:(p + 1) * w] AS x FROM v, (SELECT unnest(range(8)) AS p))",
            "c0 AS (SELECT p, rid - 1 AS e, x AS c FROM b WHERE rid <= 16)",
            *steps,
            nearest(rounds),
            "r AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{0} GROUP BY rid)".format(rounds),
            "h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{0})".format(rounds),
        ]
    ) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (rid), h"


ORACLES = {
    "op11_merkle_manifest": _MERKLE,
    "op12_substring_dedup": _REPEATS,
    "op13_vector_codes": _codes(),
    "op10_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT rid, g.k AS k, i, item FROM g JOIN win ON g.s = win.s AND g.k = win.k),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)""",
    "pii_counts": rf"""
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
       CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS DOUBLE))) <= 255)) AS BIGINT) AS n_ip,
       CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')),
                lambda m: length(m) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(m)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(m[length(m) - i] AS INT)
                     ELSE CAST(m[length(m) - i] AS INT) * 2 // 10 + CAST(m[length(m) - i] AS INT) * 2 % 10 END)) % 10 = 0)) AS BIGINT) AS n_card,
       CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT {_TEXT})""",
    "secret_counts": rf"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda m: length(m) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda m: length(m) >= 20)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda m: length(m) >= 24)) AS BIGINT) AS n_hex
FROM (SELECT {_TEXT})""",
    "edited_texts": f"""
WITH d AS (SELECT {_TEXT}),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first_value(t) OVER o) AS u FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, t))
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - length(t) // 2) || left(u, length(t) // 2)) AS edited_sha256 FROM n""",
    "url_rules": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, of_host, start, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                                         ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM p JOIN r ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN m USING (page_id)""",
    "similar_texts": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT t, min(doc_id) AS doc_id, count(*) AS copies, regexp_extract_all(lower(t), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM d GROUP BY t),
s AS (SELECT DISTINCT t, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT t, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM u WHERE len(w) > 0)),
n AS (SELECT t, count(*) AS n FROM s GROUP BY t),
q AS (SELECT DISTINCT t FROM d WHERE doc_id % 50 = 0),
b AS (SELECT a.t AS q, c.t AS t, count(*) AS m FROM s a JOIN q ON a.t = q.t JOIN s c ON a.x = c.x WHERE a.t <> c.t GROUP BY a.t, c.t),
j AS (SELECT b.q AS q, b.t AS t, CAST(m AS DOUBLE) / CAST(n1.n + n2.n - m AS DOUBLE) AS jaccard FROM b JOIN n n1 ON n1.t = b.q JOIN n n2 ON n2.t = b.t UNION ALL SELECT t, t, 1.0 FROM q)
SELECT d.doc_id AS query_id, u.doc_id AS doc_id, u.copies AS copies, jaccard FROM d JOIN j ON d.t = j.q JOIN u ON u.t = j.t WHERE d.doc_id % 50 = 0 AND jaccard >= 0.8""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return ops | {f.__name__: f for f in (pii_counts, secret_counts, edited_texts, url_rules, similar_texts)}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can state: four queries whole, and columns of others by a query beside them that reads the operator's own result."""
    return dict(ORACLES)
