"""Secret scan with DataFrame operations only: fixed patterns, plus character Markov models for tokens without a known form.

Base kinds are regular expressions. Beyond them, runs of token characters are scored by two first-order Markov chains over
characters: one trained on labelled random strings (hex, base-64, base-62 and base-36 digits of hashes), one on labelled ordinary
identifiers (words of the corpus and of a programming library, alone and joined in the usual spellings, with numbers, dates and
counters). A run of ``SHORTEST`` characters or more whose log-likelihood ratio per character exceeds a threshold for its length, or else a
piece of it between separators that does, is added as kind ``markov``. Thresholds are fitted on samples that were not counted.

Positions are code points, end exclusive. A regular expression with a lazy gap in front of each match returns gaps and
matches; running sums of their lengths give the positions, folded in chunks so that a text with very many matches stays linear.

Defined results: a null or empty text has no spans; texts are scanned whole, however long; repeated rows are scanned one by
one; a null doc_id is kept; an empty corpus leaves the identifiers of the library; extra columns of the input are ignored.
"""

from __future__ import annotations

import importlib
import math
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import table

#: The base patterns of the contract: kind, pattern, shortest whole match, shortest second group (fixed values).
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Candidates of the Markov models: their least length, and the lengths from which a threshold of its own holds.
SHORTEST, LENGTHS = 12, (16, 20, 28)
RUN = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: ASSIGN without its group, and with twelve characters at least in its place.
ASSIGN_WHOLE = ASSIGN.replace("([A-Za", "(?:[A-Za")
ASSIGN_LONG = ASSIGN_WHOLE.replace("-]+)", "-]{12,})")
#: Bounds of the labelled sample: random strings, and documents (chosen by a hash of doc_id) of which so many words, chosen by a hash, make
#: the identifiers.
RANDOM_STRINGS, IDENTIFIER_DOCS, IDENTIFIER_WORDS = 8_000, 50, 200
#: Modules whose public names are labelled ordinary identifiers.
NAME_MODULES = "argparse asyncio calendar collections concurrent.futures csv datetime decimal email.message html.parser http.client http.server inspect io ipaddress json logging.handlers mailbox multiprocessing os pathlib pickle socket socketserver statistics subprocess tarfile tempfile threading typing unittest urllib.parse urllib.request uuid xml.dom.minidom zipfile"
CHUNK = 1024


def _running(gaps: Column, matches: Column) -> Column:
    """(start, end, match) of each match, from the gaps in front of the matches; both have to be plain columns."""
    entry = "array<struct<s:int,e:int,m:string>>"

    def fold(chunk: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["g"])
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"))).alias("out"))

        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.array().cast(entry).alias("out")), step)

    def shift(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["m"].alias("m")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    chunks = F.transform(F.sequence(F.lit(1), F.size(gaps), F.lit(CHUNK)), lambda i: fold(F.arrays_zip(F.slice(gaps, i, CHUNK).alias("g"), F.slice(matches, i, CHUNK).alias("m"))))
    spans = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{entry}>").alias("out")), shift, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(gaps) > 0, spans).otherwise(F.array().cast(entry))


def _matched(df: DataFrame, text: str, patterns: dict[str, tuple[Column, str]], keep: list[str]) -> DataFrame:
    r"""For each name a column of (s, e, m): the leftmost non-overlapping matches of its pattern,
    sought only in texts that pass its cheaper condition.

    ``\G`` ties each match to the end of the one before, so that a search without success ends after one pass. The steps are
    projections of their own, so that each pattern runs twice over a text that has it, and once over any other.
    """
    none = F.array().cast("array<string>")
    flags = df.select("*", *[has.alias(f"_kl_has_{k}") for k, (has, _) in patterns.items()])
    cut = [F.when(F.col(f"_kl_has_{k}"), F.regexp_extract_all(text, F.lit(rf"\G([\s\S]*?)({p})"), g)).otherwise(none).alias(f"_kl_{n}_{k}") for k, (_, p) in patterns.items() for g, n in ((1, "g"), (2, "m"))]
    return flags.select(*keep, *cut).select(*keep, *[_running(F.col(f"_kl_g_{k}"), F.col(f"_kl_m_{k}")).alias(k) for k in patterns])


def _assigns(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` occurs; most texts have no colon or equals sign, which is cheaper to see."""
    return (text.contains("=") | text.contains(":")) & F.regexp_like(text, F.lit(pattern))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, f"^{ASSIGN}$", 1)


# --- the Markov models -------------------------------------------------------------------------------------------


def ordinary_names() -> list[str]:
    """Labelled ordinary identifiers beside those of the corpus: the public names of some modules of Python's standard library."""
    found = set()
    for name in NAME_MODULES.split():
        module = importlib.import_module(name)
        for x in dir(module):
            found |= {x, *dir(getattr(module, x))} if isinstance(getattr(module, x), type) else {x}
    return sorted(x.strip("_") for x in found if len(x.strip("_")) > 2)


def _forms(w: Column) -> Column:
    """The identifiers that up to four neighbouring words of the array ``w`` make, in the usual spellings; of each some words, some with a number."""
    at = lambda i, k: F.lower(F.get(w, (i + k) % F.size(w)))
    up = F.initcap

    def made(i: Column) -> Column:
        a, b, c, d = (at(i, k) for k in range(4))
        number = F.pmod(F.xxhash64(a, b), F.lit(10_000)).cast("string")
        forms = [a, F.concat(a, b), F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat(a, up(b)), F.concat(up(a), up(b)), F.upper(F.concat_ws("_", a, b)), F.concat(a, number)]
        forms += [F.concat_ws("_", a, b, c), F.concat_ws("/", a, b, c, d), F.concat(a, up(b), up(c), up(d)), F.concat(up(a), up(b), up(c)), F.concat(a, up(b), up(c), number), F.concat_ws("-", a, b, c, number)]
        return F.array(*forms)

    return F.when(F.size(w) > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), made))).otherwise(F.array().cast("array<string>"))


def labelled_samples(docs: DataFrame, random_strings: int = RANDOM_STRINGS, identifier_docs: int = IDENTIFIER_DOCS) -> DataFrame:
    """(label, s): 1 for random strings, 0 for ordinary identifiers and numbers. Both sides are bounded by the parameters."""
    spark = docs.sparkSession
    ids = spark.range(0, random_strings, 1, 4)
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    kind = F.col("id") % 4
    base36 = F.upper(F.concat(F.conv(F.substring(digest, 1, 15), 16, 36), F.conv(F.substring(digest, 16, 15), 16, 36), F.conv(F.substring(digest, 31, 15), 16, 36)))
    text = F.when(kind == 0, digest).when(kind == 1, b64).when(kind == 2, F.regexp_replace(b64, "[+/=]", "")).otherwise(base36)
    text = F.substring(text, F.lit(1), (SHORTEST + F.floor(F.col("id") / 4) % 32).cast("int"))
    numbers = F.array(F.date_format(F.timestamp_seconds(F.col("id") * 86_399), "yyyyMMddHHmmss"), (F.col("id") * 7_919 + 10**12).cast("string"), F.lpad(F.col("id").cast("string"), 14, "0"), F.date_format(F.timestamp_seconds(F.col("id") * 90_001), "yyyy-MM-dd-HH-mm-ss"))
    chosen = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(identifier_docs)
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z]{2,}"), 0))
    drawn = F.array_sort(F.transform(words, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x"))))
    words = chosen.select(F.transform(F.slice(drawn, 1, IDENTIFIER_WORDS), lambda x: x["x"]).alias("w"))
    names = ordinary_names()
    parts = {w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}", n)}
    order = sorted(parts, key=lambda w: zlib.crc32(w.encode()))  # neighbours in a form should not be alphabetical
    listed = lambda groups: spark.range(1).select(F.explode(F.split(F.lit("|".join(groups)), "[|]")).alias("s"))
    spread = listed(" ".join(order[i : i + 50]) for i in range(0, len(order), 50)).select(F.split("s", " ").alias("w"))
    ordinary = words.unionByName(spread).select(F.explode(_forms(F.col("w"))).alias("s"))
    ordinary = ordinary.unionByName(listed(names)).unionByName(ids.select(F.explode(numbers).alias("s")))
    return ids.select(F.lit(1).alias("label"), text.alias("s")).unionByName(ordinary.select(F.lit(0).alias("label"), "s"))


def _pairs(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))


def _length_class(s: Column) -> Column:
    """0 for the shortest candidates, one more for each bound of ``LENGTHS`` that ``s`` reaches."""
    out = F.lit(0)
    for n in LENGTHS:
        out = out + (F.length(s) >= n).cast("int")
    return out


def train(docs: DataFrame, quantile: float = 0.9995) -> tuple[list[float], list[float]]:
    """The log-likelihood ratio of each pair of characters, and for each class of length a threshold per character.

    A quarter of the samples, chosen by a hash, is not counted: on it the threshold is the quantile of ordinary identifiers or, where the
    lowest thousandth of the random strings lies above that, the middle between the two. What reaches the driver is at most one count per
    pair of characters and label, and two numbers per class.
    """
    samples = labelled_samples(docs).where(F.length("s") > 1).withColumn("held", F.pmod(F.xxhash64("s"), F.lit(4)) == 0)
    counts: dict[tuple[int, str], int] = {}
    for r in samples.where("NOT held").select("label", F.explode(_pairs(F.col("s"))).alias("p")).groupBy("label", "p").count().collect():
        counts[r["label"], r["p"]] = r["count"]
    k = len(ALPHABET)
    ratios = []
    for a in ALPHABET:
        rows = [[counts.get((label, a + b), 0) for b in ALPHABET] for label in (1, 0)]
        totals = [sum(x) + 0.5 * k for x in rows]
        ratios += [math.log((r1 + 0.5) / totals[0]) - math.log((r0 + 0.5) / totals[1]) for r1, r0 in zip(*rows, strict=True)]
    held = samples.where(F.col("held") & (F.length("s") >= SHORTEST)).select("label", _length_class(F.col("s")).alias("k"), (_ratio(F.col("s"), ratios) / F.length("s")).alias("x"))
    high = F.percentile_approx(F.when(F.col("label") == 0, F.col("x")), quantile, 10_000).alias("high")
    low = F.percentile_approx(F.when(F.col("label") == 1, F.col("x")), 0.001, 10_000).alias("low")
    fitted = {r["k"]: (r["high"], r["low"]) for r in held.groupBy("k").agg(high, low).collect()}
    thresholds = []
    for c in range(len(LENGTHS) + 1):
        high, low = fitted.get(c, (None, None))
        thresholds.append(math.inf if high is None else max(high, (high + low) / 2) if low is not None else high)
    return ratios, thresholds


def _ratio(s: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of ``s`` under the two chains; characters beyond the alphabet count 0."""
    held = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    place = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    k = len(ALPHABET)
    pair = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")),
        lambda acc, x: F.struct((acc["sum"] + F.when((x < 0) | (acc["last"] < 0), 0.0).otherwise(F.get(held, acc["last"] * k + x))).alias("sum"), x.alias("last")),
        lambda acc: acc["sum"],
    )
    return pair(place)


def _secret(s: Column, model: tuple[list[float], list[float]]) -> Column:
    """Whether the models take ``s`` for a random string."""
    ratios, thresholds = model
    least = F.element_at(F.array(*[F.lit(t) for t in thresholds]), _length_class(s) + 1)
    return (F.length(s) >= SHORTEST) & (_ratio(s, ratios) > least * F.length(s))


def _random_parts(run: Column, model: tuple[list[float], list[float]]) -> Column:
    """(s, e, m) of a run of token characters that is random, or else of its random pieces between ``/``, ``+``, ``_`` and ``-``."""
    entry = "array<struct<s:int,e:int,m:string>>"

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        here = F.array(F.struct(acc["at"].alias("s"), end.alias("e"), piece.alias("m")))
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.when(_secret(piece, model), here).otherwise(F.array().cast(entry))).alias("out"))

    pieces = F.aggregate(F.split(run["m"], "[/+_-]"), F.struct(run["s"].alias("at"), F.array().cast(entry).alias("out")), step, lambda acc: acc["out"])
    apart = F.regexp_like(run["m"], F.lit(f"[^/+_-]{{{SHORTEST}}}")) & F.regexp_like(run["m"], F.lit("[/+_-]"))
    return F.when(_secret(run["m"], model), F.array(run)).when(apart, pieces).otherwise(F.array().cast(entry))


def scan(docs: DataFrame, model: tuple[list[float], list[float]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``assign``, ``access``, ``hex`` and ``markov``: arrays of (s, e, m)."""
    # Base matches are consumed first, so that what remains of the last pattern are the runs between them.
    text = F.col("_kl_text")
    patterns = {
        "assign": (_assigns(text, ASSIGN_WHOLE), ASSIGN_WHOLE),
        "access": (text.contains("AKIA"), ACCESS),
        "hex": (F.regexp_like(text, F.lit(HEX)), HEX),
        "_kl_runs": (F.regexp_like(text, F.lit(RUN)), f"{ASSIGN_LONG}|{ACCESS}|{HEX}|{RUN}"),
    }
    shaped = lambda x: F.regexp_like(x["m"], F.lit(f"^{RUN}$")) & ~F.regexp_like(x["m"], F.lit(f"^(?:{HEX}|{ACCESS})$"))
    found = _matched(docs.select(*keep, F.coalesce("text", F.lit("")).alias("_kl_text")), "_kl_text", patterns, list(keep))
    return found.select(
        *keep,
        F.filter("assign", lambda x: F.length(_value(x["m"])) >= 12).alias("assign"),
        "access",
        "hex",
        F.flatten(F.transform(F.filter("_kl_runs", shaped), lambda x: _random_parts(x, model))).alias("markov"),
    )


def _digest(*kinds: str) -> Column:
    """kind:start:end of all spans, by start and then by kind as listed."""
    tagged = F.concat(*[_tagged(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(tagged), lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def redact(docs: DataFrame, model: tuple[list[float], list[float]], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the scan in ``text`` replaced by ``mark`` (spans that touch or overlap by one); other text, and a null
    text, stay as they are."""
    own = docs.columns
    found = scan(docs.withColumn("_kl_own", F.struct(*own)), model, keep=("_kl_own",))
    spans = F.sort_array(F.concat(*[F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS]))
    text = F.col("_kl_own.text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        fresh = (x["s"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], F.when(fresh, gap).otherwise(F.array().cast("array<string>"))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(F.col("_kl_spans"), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    shown = found.withColumn("_kl_spans", spans).withColumn("_kl_shown", F.when(F.size("_kl_spans") > 0, cut).otherwise(text))
    return shown.select(*[F.col("_kl_shown").alias(c) if c == "text" else F.col("_kl_own").getField(c).alias(c) for c in own])


def base_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can tell: the base kinds without the models' spans."""
    return op4_secret_scans(spark, sf_dir).drop("spans")


_SPANS = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS hit, regexp_split_to_array(t, '{p}') AS gap FROM d"
    for n, (kind, p) in enumerate((("assign", ASSIGN_WHOLE.replace("'", "''")), ("access", ACCESS), ("hex", HEX)))
)
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_SPANS}),
s AS (SELECT doc_id, n, kind, hit[i] AS found, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m)),
k AS (SELECT *, s + length(found) AS e FROM s WHERE n > 0 OR length(regexp_extract(found, '^{ASSIGN.replace("'", "''")}$', 1)) >= 12)
SELECT d.doc_id, count(*) FILTER (n = 0)::BIGINT AS n_assign, count(*) FILTER (n = 1)::BIGINT AS n_access, count(*) FILTER (n = 2)::BIGINT AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, n), '')) AS base_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return scan(docs, train(docs)).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_digest("assign", "access", "hex"), 256).alias("base_sha256"), _digest(*KINDS).alias("spans"))
