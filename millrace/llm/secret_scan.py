"""Secrets in texts: candidates by form, false positives removed by a random forest.

Every long run of credential characters is a candidate, and so is every value, of whatever length and
characters, that is quoted or assigned after a word that announces a credential. What tells a secret from a word, a
number or an address is learned from labelled findings: the candidate's length, its
character transitions, how much of it dictionary words cover, the path it was found under
and the words next to it.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: A candidate, and how far around it its neighbours are looked for.
CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_.\-]{13,}={0,2}")
AROUND = 40
BLANK = re.compile(r"\s")
#: Labelled findings of either class that the forest is fitted on, at most.
MOST_PER_LABEL = 5_000
TREES, DEPTH, SEED = 20, 8, 7
PATH_BUCKETS = WORD_BUCKETS = 16
DICTIONARY_LETTERS = 3

#: Words that announce a credential, and parts of paths that hold made-up ones.
CREDENTIAL = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "auth", "bearer", "credential")
MADE_UP = ("test", "example", "sample", "fixture", "mock", "doc")

#: What announces a value: such a word, its quote if any, and an assignment or the value's own quote.
_NAMES = "|".join(CREDENTIAL)
_SIGN = r"(?:={1,3}>?|:=|:)"
LEAD = re.compile(rf"(?ai)(?:{_NAMES})(?:[\"'\]]{{0,2}}[ \t]*{_SIGN}[ \t]*|[ \t]*(?=[\"']))")
#: The value: up to its own quote, or up to white space, without the brackets and commas before that.
VALUE = re.compile(r"""(?:"((?:\\.|[^"\\\n])+)"|'((?:\\.|[^'\\\n])+)'|["']?([^\s"']\S*))""")
CLOSING = "\"',;)]}"
ANNOUNCED = rf"(?i)({_NAMES})([\"'\]]{{0,2}}\s*{_SIGN}\s*[\"']?|\s*[\"'])$"
#: An announced number that is shorter than this may be a count as well as a secret.
LEAST_NUMBER = 14

FEATURES = (
    "length", "class_changes", "rare_transitions", "distinct", "entropy", "digits", "upper", "punctuation",
    "coverage", "made_up_path", "path_bucket", "path_depth", "credential_before", "assigned", "quoted", "address",
    "word_before", "word_after",
)


class Dictionary:
    """Words and the frequency of letter pairs, from the entries of a public vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        stripped = (e.lstrip("Ġ").lower() for e in entries)
        self.words = {w for w in stripped if len(w) >= DICTIONARY_LETTERS and w.isascii() and w.isalpha()}
        self.longest = max(map(len, self.words), default=0)
        pairs = Counter(a + b for w in self.words for a, b in zip(w, w[1:]))
        total = sum(pairs.values()) or 1
        self.pairs = {p: math.log(n / total) for p, n in pairs.items()}
        self.rarest = math.log(0.5 / total)

    def coverage(self, value: str) -> float:
        """The share of characters in words found from left to right, the longest first."""
        low, at, covered = value.lower(), 0, 0
        while at < len(low):
            for size in range(min(self.longest, len(low) - at), DICTIONARY_LETTERS - 1, -1):
                if low[at : at + size] in self.words:
                    covered += size
                    at += size
                    break
            else:
                at += 1
        return covered / len(low)

    def rarity(self, value: str) -> float:
        """Mean negated log frequency of neighbouring characters among dictionary words."""
        low = value.lower()
        return -sum(self.pairs.get(a + b, self.rarest) for a, b in zip(low, low[1:])) / max(len(low) - 1, 1)


@lru_cache(maxsize=1)
def dictionary(path: str) -> Dictionary:
    return Dictionary(path)


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.lower().encode()) % buckets


def _class(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


def announced(content: str) -> Iterator[tuple[int, int]]:
    """Spans of the announced values. What looks like a lead within an unbroken value is part of it, so
    the values of a text are together no longer than a few times the text."""
    inside = 0
    for lead in LEAD.finditer(content):
        if lead.end() <= inside:
            continue
        value = VALUE.match(content, lead.end())
        if value is None:
            continue
        begin, end = value.span(value.lastindex)
        if value.lastindex == 3:
            end = begin + 1 + len(content[begin + 1 : end].rstrip(CLOSING))
        if not BLANK.search(content, begin, end):
            inside = max(inside, end)
        yield begin, end


def candidates(content: str) -> list[tuple[int, int]]:
    """Spans of the candidates, in order. A run within an announced value without blanks is part of it."""
    values = set(announced(content))
    if not values:
        return [m.span() for m in CANDIDATE.finditer(content)]
    whole = sorted(s for s in values if not BLANK.search(content, *s))
    alone, last, at = [], -1, 0
    for a, b in (m.span() for m in CANDIDATE.finditer(content)):
        while at < len(whole) and whole[at][0] <= a:
            last, at = max(last, whole[at][1]), at + 1
        if b > last:
            alone.append((a, b))
    return sorted(values.union(alone))


def described(value: str, before: str, after: str, path: str, known: Dictionary) -> list[float]:
    """The ``FEATURES`` of one finding."""
    classes, counts = [_class(c) for c in value], Counter(value)
    size, path = len(value), path.lower()
    heads, tails = re.findall(r"\w+", before), re.findall(r"\w+", after)
    announced = any(c in w.lower() for w in heads[-2:] for c in CREDENTIAL)
    return [
        size,
        sum(a != b for a, b in zip(classes, classes[1:])) / max(size - 1, 1),
        known.rarity(value),
        len(counts) / size,
        -sum(n / size * math.log2(n / size) for n in counts.values()),
        classes.count(0) / size,
        classes.count(2) / size,
        classes.count(3) / size,
        known.coverage(value),
        float(any(m in path for m in MADE_UP)),
        _bucket(path, PATH_BUCKETS),
        path.count("/"),
        float(announced),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)),
        float(after[:1] == "@" or before[-1:] == "@"),
        _bucket(heads[-1], WORD_BUCKETS) if heads else -1,
        _bucket(tails[0], WORD_BUCKETS) if tails else -1,
    ]


def findings(docs: DataFrame, words: str, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(``key``, start, value, before, after, features), a row per candidate of the whole texts.

    ``start`` counts code points. ``words`` is the path of a vocabulary that executors can open.
    """
    kind = docs.schema[key].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dictionary(words)
        names = [key, "start", "value", "before", "after", "features"]
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, pa.list_(pa.float64())]
            rows = []
            for owner, content, where in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for a, b in candidates(content or ""):
                    value, *sides = content[a:b], content[max(a - AROUND, 0) : a], content[b : b + AROUND]
                    rows.append((owner, a, value, *sides, described(value, *sides, where or "", known)))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    columns = [F.col(key), F.col(text).cast("string"), F.col(path).cast("string")]
    return docs.select(*columns).mapInArrow(
        found, f"`{key}` {kind}, start bigint, value string, before string, after string, features array<double>"
    )


def by_grammar() -> Column:
    """Labels of findings whose form alone tells: 1 for a vendor's key or an announced value with
    digits; 0 for words, numbers, and addresses that nothing announces; null for the rest, which is not learned from."""
    vendor = F.col("value").rlike("^AKIA[0-9A-Z]{16}$")
    announced = F.col("before").rlike(ANNOUNCED)
    count = F.col("value").rlike("^[0-9.]+$") & (F.length("value") < LEAST_NUMBER)
    plain = F.col("value").rlike(r"^([A-Za-z.\-]+|[0-9.]+)$") | F.col("after").startswith("@") | F.col("before").endswith("@")
    return F.when(vendor | (announced & F.col("value").rlike("[0-9]") & ~count), 1).when(plain & ~announced, 0)


def sampled(labelled: DataFrame, most_per_label: int = MOST_PER_LABEL) -> DataFrame:
    """(features, label, weight): at most ``most_per_label`` different findings of either class, the first by
    hash, each with the number of times it occurs: one that very many rows repeat takes one place."""
    different = labelled.groupBy("features", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hashed = F.xxhash64("features", "label")
    sides = [different.where(F.col("label") == n).orderBy(hashed, "features").limit(most_per_label) for n in (0, 1)]
    return sides[0].unionByName(sides[1])


def fit(labelled: DataFrame, most_per_label: int = MOST_PER_LABEL):
    """A forest over (features, label), fitted on the ``sampled`` findings; None unless there are both classes."""
    vectors = sampled(labelled, most_per_label).select(F.col("label").cast("double"), array_to_vector("features").alias("vector"), "weight")
    sample = materialize(vectors.coalesce(1), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="vector", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(sample)


def scan_secrets(
    docs: DataFrame,
    words: str,
    labels: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    path: str = "source",
    most_per_label: int = MOST_PER_LABEL,
) -> DataFrame:
    """(``key``, start, length, value, probability, secret), a row per candidate.

    ``labels`` is 1, 0 or null for a finding, given its ``value``, ``before``, ``after`` and ``key``
    (default: ``by_grammar``). ``secret`` is a probability of at least a half. If the labelled
    findings are not of both classes nothing can be learned: the probability is null and every candidate
    stays a secret. Null and empty texts have no candidates; a null path is an empty one. Repeated
    rows and null keys are reported each. Other columns are not read.
    """
    all_ = materialize(findings(docs, words, key, text, path), "findings")
    label = by_grammar() if labels is None else labels
    model = fit(all_.select("features", label.alias("label")).where("label is not null"), most_per_label)
    if model is None:
        scored = all_.withColumn("probability", F.lit(None).cast("double"))
    else:
        seen = model.transform(all_.withColumn("vector", array_to_vector("features")))
        scored = seen.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    secret = F.coalesce(F.col("probability") >= 0.5, F.lit(True))
    return scored.select(key, "start", F.length("value").cast("bigint").alias("length"), "value", "probability", secret.alias("secret"))
