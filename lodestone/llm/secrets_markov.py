"""Secret scans by fixed patterns and by character Markov models, in DataFrame functions only.

The patterns find assignments, access keys and hex runs. In what is left, each token of 20 or more characters is
scored by two first-order character models, one of random strings and one of ordinary identifiers: a token is a
secret if the log-likelihood ratio favours the random one by enough, in total and for each character.

The random model learns from hashes, spelt in hex and base 64, and from values that the patterns find; the ordinary
one from a list of identifiers, from identifiers made of the words of a bounded sample of documents, and from the sample's
other tokens. Every second labelled token, by hash, is held out: the margin a character pair is the largest that 99 of
100 held-out random tokens of 20 characters or more reach, or a larger one if more than one in a thousand of the
held-out ordinary ones would reach that; what either kind reaches is reported (Model.recall, Model.passed). Offsets are code points, the end exclusive.
Null and empty texts have no spans; repeated rows get the same result each; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

# The patterns of the contract. Possessive quantifiers only spare time.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WIDE = len(ALPHABET) + 1
# Labelled ordinary identifiers in the usual styles; each counts ORDINARY_TIMES times.
ORDINARY = """
addEventListener application_settings authenticationManager background-color-primary buildConfiguration calculateTotalAmount
charactersRemaining com/example/service/Controller component_registry ConnectionPoolManager content-security-policy
createElementFromTemplate current_user_session DatabaseMigrationRunner default_timeout_seconds deserializeMessage
documentationUrl environment_variables EventDispatcherFactory exception_handling_policy fetchRemoteResources
first_name_last_name formatDateWithTimezone getElementById getNextAvailableIndex hello_world_example HttpResponseStatusCode
identifier_of_some_length index_of_last_element initializeComponents InputStreamReader internationalization isAuthenticated
javascript/typescript/modules keyboardShortcutHandler language_identification lastModifiedTimestamp loadBalancerEndpoint
max_connections_per_host MessageQueueConsumer navigation-bar-container notificationPreferences NumberFormatException
onConfigurationChanged operating_system_version organization_settings parseCommandLineArguments password_reset_required
performance_monitoring playbackRateControl PropertyChangeListener quantity_available_in_stock queryParameterBuilder
readOnlyRepository registered_domain_suffix RequestValidationError responsibilities scheduleBackgroundTask
SerializationContext session_expiration_date shoppingCartContents sourceCodeRepository StringBuilderUtilities
subscription_renewal_date supportedLanguages synchronizeFileSystem table_of_contents temporaryDirectory
transaction_isolation_level TransformationMatrix unexpectedEndOfInput updateInventoryRecord user_interface_language
validateEmailAddress verificationToken visibleColumnHeaders windows-registry-editor workspaceConfiguration
""".split()
ORDINARY_TIMES = 20

#: Rows of the documents, and strings of either spelling, that the models learn from at most.
SAMPLE_ROWS, RANDOM_STRINGS = 2000, 4000
#: Nats that must favour the random model in a token: as if one candidate in a million were a secret.
TOTAL = math.log(1e6)
#: Share of held-out ordinary tokens that may pass the margin, share of random ones that should, and the least margin.
PASS, FIND, LEAST_MARGIN = 0.001, 0.99, 0.1
OPEN, CLOSE = "", ""


def _bind(value: Column, f) -> Column:
    """f(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _shifted(d: int):
    return lambda a: F.when(F.size(a) <= d, a).otherwise(F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - d), F.lit(0))))


def _running(numbers: Column) -> Column:
    """Running sums of an array, in passes of doubled distance."""
    for k in range(24):
        numbers = _bind(numbers, _shifted(1 << k))
    return numbers


def _pieces(text: Column, pattern: str) -> Column:
    """The text before the first match, then for each match: match, CLOSE and the text behind it."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), OPEN)


def _spans(pieces: Column, kind: str) -> Column:
    """Structs of start, rank of the kind, end and match."""

    def of(p: Column) -> Column:
        lengths = F.transform(p, lambda x, i: F.char_length(x) - F.when(i == 0, 0).otherwise(1))
        found = lambda sums: F.transform(
            F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
            lambda x, i: _bind(
                F.substring_index(x, CLOSE, 1),
                lambda m: F.struct(F.get(sums, i).cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (F.get(sums, i) + F.char_length(m)).cast("long").alias("end"), m.alias("match")),
            ),
        )
        none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,match:string>>")
        return F.when(F.size(p) > 1, _bind(_running(lengths), found)).otherwise(none)

    return _bind(pieces, of)


def _blanked(pieces: Column, true) -> Column:
    """The text again, with spaces for the matches that hold."""
    back = lambda x, i: F.when(i == 0, x).otherwise(
        _bind(F.substring_index(x, CLOSE, 1), lambda m: F.concat(F.when(true(m), F.repeat(F.lit(" "), F.char_length(m))).otherwise(m), F.substring_index(x, CLOSE, -1)))
    )
    return F.array_join(F.transform(pieces, back), "")


def _blank_if(true):
    return lambda pieces: _blanked(pieces, true)


def _long_value(m: Column) -> Column:
    return F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6


def _base(text: Column) -> tuple[Column, Column, Column]:
    """Arrays of spans of the three patterns."""
    assign = F.filter(_spans(_pieces(text, ASSIGN), "assign"), lambda s: _long_value(s["match"]))
    return assign, _spans(_pieces(text, ACCESS), "access"), _spans(_pieces(text, HEX), "hex")


def _rest(text: Column) -> Column:
    """The text with spaces in place of the patterns' spans."""
    some = text.rlike(ASSIGN)
    text = F.when(some, _bind(_pieces(text, ASSIGN), lambda p: _blanked(p, _long_value))).otherwise(text)
    return F.regexp_replace(text, F.lit(f"{ACCESS}|{HEX}"), F.lit(" "))


def _clean(text: Column) -> Column:
    """No null, and none of the two marks, which are in no pattern."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "��")).otherwise(text)


def _classes(token: Column) -> Column:
    """Place of each character in ALPHABET from 1 on, 0 for others."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _pairs(token: Column) -> Column:
    """Numbers of the character pairs in order."""
    of = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: a * WIDE + b)
    return _bind(_classes(token), of)


class Model(NamedTuple):
    """ratio: log-likelihood ratio of each character pair, random over ordinary. The rest is measured on held-out tokens."""

    ratio: list[float]
    margin: float  # nats for each pair of characters
    recall: float  # share of the random tokens that are told, null without any
    passed: float  # share of the ordinary tokens that are taken for random
    tokens: tuple[int, int]  # held-out ordinary and random tokens


def _score(pairs: Column, ratio: list[float]) -> Column:
    model = F.split(F.lit(",".join(f"{x:.5f}" for x in ratio)), ",").cast("array<double>")
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.get(model, p))


def labelled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """token, random (1 or 0) and weight of the tokens that the models learn from; docs has doc_id and text."""
    spark = docs.sparkSession
    total = max(docs.count(), 1)
    share = min(1.0, sample_rows / total)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("secrets")), F.lit(1_000_000))
    # the cut is by the draw, so that each run learns from the same rows, also where one id has many
    sample = docs.where(draw < max(int(share * 1_000_000), 1)).orderBy(draw, "doc_id", "text").limit(sample_rows).select(_clean(F.col("text")).alias("text"))
    values = F.concat(
        F.transform(F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0)), _long_value), lambda m: F.regexp_extract(m, ASSIGN, 2)),
        F.regexp_extract_all("text", F.lit(f"{ACCESS}|{HEX}"), F.lit(0)),
    )
    found = sample.select(F.explode(values).alias("token"), F.lit(1).alias("random"), F.lit(1).alias("weight"))
    other = sample.select(F.regexp_extract_all(_rest(F.col("text")), F.lit("[A-Za-z0-9+/_=-]{4,}+"), F.lit(0)).alias("t"))
    # every word with the two behind it: an identifier in one of four styles, by hash
    styles = lambda three: F.element_at(F.array(F.array_join(three, "_"), F.array_join(F.transform(three, F.initcap), ""), F.array_join(three, "-"), F.upper(F.array_join(three, "_"))), F.pmod(F.xxhash64(three), F.lit(4)).cast("int") + 1)
    threes = F.transform(F.filter(F.sequence(F.lit(1), F.size("t") - 2, F.lit(3)), lambda i: i > 0), lambda i: styles(F.slice("t", i, 3)))
    made = other.where(F.size("t") > 2).select(F.explode(threes).alias("token"), F.lit(0).alias("random"), F.lit(1).alias("weight"))
    other = other.select(F.explode("t").alias("token"), F.lit(0).alias("random"), F.lit(1).alias("weight"))
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256)
    random = spark.range(RANDOM_STRINGS).select(F.explode(F.array(digest, F.base64(F.unhex(digest)))).alias("token"), F.lit(1).alias("random"), F.lit(1).alias("weight"))
    known = spark.range(1).select(F.explode(F.split(F.lit(" ".join(ORDINARY)), " ")).alias("token"), F.lit(0).alias("random"), F.lit(ORDINARY_TIMES).alias("weight"))
    return found.unionByName(other).unionByName(made).unionByName(random).unionByName(known)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model, learnt from half of the labelled tokens; the margin is set, and measured, on the other half."""
    tokens = labelled(pick(docs, "doc_id", "text"), sample_rows)
    held = F.pmod(F.xxhash64("token", F.lit("held")), F.lit(2)) == 1
    counts = tokens.where(~held).select("random", "weight", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.sum("weight").alias("count"))
    table = [[0.5] * (WIDE * WIDE), [0.5] * (WIDE * WIDE)]
    for r in counts.collect():  # two numbers for each pair of characters at most
        table[r.random][r.pair] += r["count"]
    ratio = []
    for a in range(WIDE):
        rows = [t[a * WIDE : (a + 1) * WIDE] for t in table]
        sums = [sum(r) for r in rows]
        ratio += [math.log(y / sums[1]) - math.log(x / sums[0]) for x, y in zip(*rows, strict=True)]
    tests = tokens.where(held & (F.char_length("token") >= 20)).select("random", _bind(_pairs(F.col("token")), lambda p: F.struct(_score(p, ratio).alias("score"), F.size(p).alias("n"))).alias("s")).select("random", "s.*")
    tests = tests.groupBy("random", F.floor(F.col("score") / F.col("n") * 100).alias("bin"), (F.col("score") >= TOTAL).alias("sure")).count().collect()  # bins of a hundredth of a nat
    n = [sum(r["count"] for r in tests if r.random == k) for k in (0, 1)]
    margin = LEAST_MARGIN
    for kind, share in ((1, FIND), (0, PASS)):
        over = 0
        for r in sorted((r for r in tests if r.random == kind and r.sure), key=lambda r: -r.bin):
            over += r["count"]
            if over > share * n[kind]:
                margin = max(margin, (r.bin + (1 - kind)) / 100)
                break
    above = [sum(r["count"] for r in tests if r.random == k and r.sure and r.bin >= round(margin * 100)) for k in (0, 1)]
    return Model(ratio, margin, above[1] / max(n[1], 1), above[0] / max(n[0], 1), (n[0], n[1]))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of each kind, base_sha256, spans and n_markov for each row of docs."""
    docs = pick(docs, "doc_id", "text")
    model = train(docs) if model is None else model
    random = lambda m: _bind(_pairs(m), lambda p: _bind(_score(p, model.ratio), lambda s: (s >= TOTAL) & (s >= model.margin * F.size(p))))
    docs = docs.select("doc_id", _clean(F.col("text")).alias("text"))
    assign, access, hexes = _base(F.col("text"))
    docs = docs.select("doc_id", "text", assign.alias("a"), access.alias("k"), hexes.alias("x"))
    base = F.array_sort(F.concat("a", "k", "x"))
    true = {"a": _long_value, "k": lambda m: F.lit(True), "x": lambda m: F.lit(True)}
    left = F.col("text")
    for col, pattern in (("a", ASSIGN), ("k", ACCESS), ("x", HEX)):
        left = F.when(F.size(col) > 0, _bind(_pieces(left, pattern), _blank_if(true[col]))).otherwise(left)
    # an earlier kind's blanks may break a later kind's match in two or hide it; what overlaps a span is dropped
    more = F.filter(_spans(_pieces(left, CANDIDATE), "markov"), lambda s: random(s["match"]) & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    docs = docs.select("doc_id", "text", "a", "k", "x", base.alias("base")).select("doc_id", "a", "k", "x", "base", more.alias("m"))
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
    return docs.select(
        "doc_id",
        F.size("a").cast("long").alias("n_assign"),
        F.size("k").cast("long").alias("n_access"),
        F.size("x").cast("long").alias("n_hex"),
        F.sha2(show(F.col("base")), 256).alias("base_sha256"),
        show(F.array_sort(F.concat("base", "m"))).alias("spans"),
        F.size("m").cast("long").alias("n_markov"),
    )
