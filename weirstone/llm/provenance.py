"""Problem 2: generated, minified, vendored source files and data stored as code.

A random forest is trained on compression ratio, token entropy, identifier lengths,
comment density and further statistics of a file's text, labelled by header notices
("generated by", "do not edit" ...) that its features do not see: the lines are taken
out before anything is measured.  Data files carry no notices; files that are one
literal are labelled by that.

The forest alone decides, in three steps, because notices are few and the bodies of
vendored copies look like any other code:

1. Text statistics and the path.  What a path's words tell is learned from the labels
   of the other files with that word.  Only some of the files that are not hand-written
   say so, so the labels are positive and unlabelled cases: a file counts from half-way
   between the share of the labelled ones and the probability that their surest quarter reaches.
2. What comment lines at a file's ends tell is learned by their words, from the first
   step's decisions, which did not see them.  Lines that merely speak of generated files
   stand in hand-written ones, so their words tell little.
3. A forest on all these features, labelled by either of the two; then steps 2 and 3
   once more with its decisions.

Words are hashed into BUCKETS places, so what is learned of them has a fixed size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep
from .syntax import SUFFIX

#: Phrases of notices, case folded; fixed values.
NOTICES = re.compile(
    r"(?i)@generated\b|\bauto-?generated\b|\bautomatically generated\b|\bgenerated (?:by|from)\b|\bmachine[- ]generated\b|\bdo not (?:edit|modify)\b|\bvendored\b|\bbundled copy\b|\bthird[- ]party code\b|\bcopied verbatim\b|[#@] ?sourcemappingurl=|^\s*/\*!|\bv\d[\w.]* \| \(c\)"
)
_COMMENT = re.compile(r"^\s*(?:#(?!include|define|if|endif|else|pragma|undef)|//|/\*|\*|--|;|<!--)")
_CODE = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[^\w\s]")
FEATURES = [
    "ratio", "token_entropy", "byte_entropy", "ident_mean", "ident_long", "ident_short", "comment_share", "line_mean", "line_max", "line_longest_share", "digit_share", "space_share",
    "literal_share", "string_longest_share", "punct_share", "distinct_share", "log_chars", "log_lines", "number_share",
]
#: Share of a text inside string and number literals from which it is labelled data.
DATA_SHARE = 0.80
#: Thresholds tried for a feature, less one.
BINS = 48
#: Most rows that a forest is fitted on; the sample is taken by a hash of the key.
FIT_ROWS = 12_000
#: Fewest files in a leaf: fewer would learn unmarked cases by heart.
LEAF = 20
#: Places that words are hashed into.
BUCKETS = 1 << 19
#: Parts of the files, by their keys; a file's words are judged by the labels of the other parts.
FOLDS = 3
#: Weight, in files, of the share of all files in what a word tells.
PRIOR = 20.0
#: Lines at a file's beginning and end whose comments are read.
ENDS = (12, 3)
_SCHEMA = "artifact_id bigint, notice boolean, data boolean, path_words array<int>, lines array<array<int>>, " + ", ".join(f"{c} double" for c in FEATURES)
_WORD = re.compile(r"[^\W\d_]+|[@#<=\"!?]|\S*[\d_]\S*")


def bucket(word):
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def path_words(path):
    """Places of the words of a path: its folders, and the parts of the file's name, which keep their place from the end; not the ending by itself, which is the language's."""
    *folders, name = path.lower().split("/")
    words = {"/" + x for x in folders}
    parts = re.split(r"(?=[._-])", name)
    words |= {"".join(parts[-k:]) for k in (2, 3) if k < len(parts)} | {f"{k}{x}" for k, x in enumerate(reversed(parts)) if k}
    return sorted({bucket(w) for w in words})


def line_words(lines):
    """Places of the words and pairs of words of the comment lines at a file's ends, by line; words with digits or underscores are one."""
    n = len(lines)
    out = []
    for i in sorted({*range(min(n, ENDS[0])), *range(max(0, n - ENDS[1]), n)}):
        if _COMMENT.match(lines[i]):
            words = [w.lower() if w.isalpha() else w if len(w) == 1 else "0" for w in _WORD.findall(lines[i][:400])]
            if words:
                out.append(sorted({bucket("l " + w) for w in words} | {bucket(f"l {a} {b}") for a, b in zip(["", *words], words)}))
    return out


def notice_lines(lines):
    """Indices of the comment lines that are notices, or speak of them."""
    return [i for i, x in enumerate(lines) if _COMMENT.match(x) and NOTICES.search(x)]


def _entropy(counts, n):
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def _bytes_entropy(raw):
    if not raw:
        return 0.0
    p = np.bincount(np.frombuffer(raw, np.uint8), minlength=1)
    p = p[p > 0] / len(raw)
    return float(-(p * np.log2(p)).sum())


#: One of these stands in every notice, in lower case.
_HINTS = ("generated", "vendored", "bundled", "third", "verbatim", "sourcemappingurl", "do not", "/*!", "| (c)")


def measure(path, text):
    """(has a notice, is one literal, words of the path, words of the comment lines, features of the text without its notices)."""
    lines = text.split("\n")
    words = line_words(lines)
    low = text.lower()
    hidden = set(notice_lines(lines)) if any(h in low for h in _HINTS) else set()
    text = "\n".join(x for i, x in enumerate(lines) if i not in hidden).strip()  # nor do the ends show that a line was there
    lines = text.split("\n")
    n = len(text) or 1
    raw = text.encode("utf-8", "surrogatepass")
    toks = _CODE.findall(text)
    counts = Counter(toks)
    nt = len(toks) or 1
    idents = [(t, c) for t, c in counts.items() if t[0].isalpha() or t[0] == "_"]
    ni = sum(c for _, c in idents) or 1
    lengths = [len(x) for x in lines]
    comments = sum(len(x) for x in lines if _COMMENT.match(x))
    strings = [(len(t), c) for t, c in counts.items() if t[0] in "\"'" and len(t) > 1]
    numbers = sum(c * len(t) for t, c in counts.items() if t[0].isdigit())
    in_strings = sum(a * c for a, c in strings)
    dense = sum(len(t) * c for t, c in counts.items()) or 1
    longest = max(lengths, default=0)
    commas = counts.get(",", 0) + counts.get("[", 0) + counts.get("]", 0) + counts.get("{", 0) + counts.get("}", 0) + counts.get(":", 0)
    literal = (numbers + in_strings + commas) / dense
    values = [
        len(zlib.compress(raw, 1)) / (len(raw) or 1),
        _entropy(counts, nt),
        _bytes_entropy(raw),
        sum(len(t) * c for t, c in idents) / ni,
        sum(c for t, c in idents if len(t) > 20) / ni,
        sum(c for t, c in idents if len(t) <= 2) / ni,
        comments / n,
        n / (len(lines) or 1),
        math.log1p(longest),
        longest / n,
        sum(map(text.count, "0123456789")) / n,
        (text.count(" ") + text.count("\n") + text.count("\t")) / n,
        literal,
        max((a for a, _ in strings), default=0) / n,
        sum(c for t, c in counts.items() if len(t) == 1 and not t.isalnum()) / nt,
        len(counts) / nt,
        math.log1p(n),
        math.log1p(len(lines)),
        numbers / dense,
    ]
    data = len(text) > 200 and literal >= DATA_SHARE and sum(len(t) * c for t, c in idents) <= 0.2 * dense
    return bool(hidden), data, path_words(path), words, values


def _measure(batches):
    for b in batches:
        rows = []
        for key, path, text in zip(b.artifact_id, b.path, b.content):
            notice, data, ways, lines, values = measure(path, text)
            rows.append((key, notice, data, ways, lines, *values))
        yield pd.DataFrame(rows, columns=["artifact_id", "notice", "data", "path_words", "lines", *FEATURES])


def features(artifacts: DataFrame) -> DataFrame:
    """Labels and features of every source file with content; other rows give none."""
    some = artifacts.select("artifact_id", "path", "content").where(F.col("artifact_id").isNotNull() & F.col("content").isNotNull() & F.col("path").rlike(SUFFIX))
    return some.mapInPandas(_measure, _SCHEMA).dropDuplicates(["artifact_id"])


def _learned(files: DataFrame, words: str, label: str):
    """(files with a word, of them labelled) by fold and place, without those of the fold; the driver gets FOLDS x BUCKETS pairs of numbers at most."""
    each = files.select("fold", F.col(label).cast("bigint").alias("y"), F.explode(words).alias("w")).groupBy("fold", "w").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    n, y = np.zeros((FOLDS, BUCKETS)), np.zeros((FOLDS, BUCKETS))
    some = each.toPandas()
    at = some.fold.to_numpy(), some.w.to_numpy()
    n[at], y[at] = some.n, some.y
    return n.sum(0) - n, y.sum(0) - y


def tells(n, y, share):
    """What words tell: (the logarithm of the share of labelled files among those with the word, against the
    share of all, and how sure that is as a signed likelihood ratio)."""
    q = np.clip(y / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    sure = n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
    return np.log((y + PRIOR * share) / (n + PRIOR) / share), np.where(q > share, sure, -sure)


def _scored(files: DataFrame, column: str, words: str, label: str) -> DataFrame:
    """files with what their words tell by the labels of the other folds: for a path its surest word, for comment
    lines the mean of a line's words, of the line where it is greatest. Columns: column, and column_sure."""
    by_line = words == "lines"
    flat = F.array_distinct(F.flatten(words)) if by_line else F.col(words)
    share = min(0.999, max(0.001, files.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.5))
    n, y = _learned(files.select("fold", label, flat.alias("w")), "w", label)
    table = files.sparkSession.sparkContext.broadcast([a.astype(np.float32) for a in tells(n, y, share)])  # FOLDS x BUCKETS pairs of numbers

    @F.pandas_udf("told double, sure double")
    def score(some: pd.Series, fold: pd.Series) -> pd.DataFrame:
        told, sure = table.value
        out = []
        for x, k in zip(some, fold):
            best = (0.0, 0.0)
            if by_line:
                best = max(((float(told[k, w].mean()), float(sure[k, w].mean())) for w in x), default=best)
            elif len(x):
                i = x[int(sure[k, x].argmax())]
                best = float(told[k, i]), float(sure[k, i])
            out.append(best)
        return pd.DataFrame(out, columns=["told", "sure"])

    both = files.withColumn("both", score(words, "fold"))
    return both.withColumns({column: F.col("both.told"), column + "_sure": F.col("both.sure")}).drop("both")


def _forest(files: DataFrame, inputs: list, label: str, fit_rows: int, trees: int, depth: int, cross: bool = False) -> DataFrame:
    """files with the probability p of ``label`` by a forest fitted on at most fit_rows of them; if cross, by that
    of two forests that was fitted on the other half of the files. Where all labels are alike, p is the label itself."""
    half = F.pmod(F.xxhash64("artifact_id", F.lit("half")), F.lit(2)).cast("int")
    labelled = VectorAssembler(inputCols=inputs, outputCol="x").transform(files.withColumns({"y": F.col(label).cast("double"), "half": half}))
    sample = labelled.select("artifact_id", "x", "y", "half").orderBy(F.xxhash64("artifact_id"), "artifact_id").limit(fit_rows)
    fit = keep(sample.select(vector_to_array("x").alias("x"), "y", "half")).select(array_to_vector("x").alias("x"), "y", "half")
    sizes = {(r["half"], r["y"]) for r in fit.select("half", "y").distinct().collect()}  # at most four rows
    if len({y for _, y in sizes}) < 2 or cross and len(sizes) < 4:
        return labelled.withColumn("p", F.col("y")).drop("x", "y", "half")
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="0.6", maxBins=BINS, minInstancesPerNode=LEAF)
    out, cols = labelled, ["rawPrediction", "probability", "prediction"]
    for k in (0, 1) if cross else (0,):
        model = forest.fit(fit.where(F.col("half") != k) if cross else fit)
        out = model.transform(out).withColumn(f"p{k}", vector_to_array("probability")[1]).drop(*cols)
    p = F.when(F.col("half") == 0, F.col("p0")).otherwise(F.col("p1")) if cross else F.col("p0")
    return out.withColumn("p", p).drop("x", "y", "half", "p0", "p1")


def provenance(artifacts: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 40, depth: int = 8, rounds: int = 3) -> DataFrame:
    """One row per source file: notice (the label), data (likewise), seen (probability by text and path alone), probability, handwritten.

    Forests are fitted on at most fit_rows files, those with the least hash of their key;
    features, what words tell, and the decision cover all. Where all labels are alike, or there
    are no rows, only the labels decide. Empty files are hand-written."""
    known = keep(features(artifacts).withColumn("label", F.col("notice") | F.col("data")).withColumn("fold", F.pmod(F.xxhash64("artifact_id", F.lit("fold")), F.lit(FOLDS)).cast("int")))
    first = _forest(_scored(known, "path", "path_words", "notice"), [*FEATURES, "path", "path_sure"], "label", fit_rows, trees, depth, cross=True).withColumnRenamed("p", "seen")
    first = keep(first)
    sure, share = first.agg(F.percentile_approx(F.when(F.col("notice"), F.col("seen")), 0.75), F.avg(F.col("notice").cast("double"))).first()
    least = ((1.0 if sure is None else sure) + (share or 0.0)) / 2
    now = first.withColumn("marked", (F.col("seen") >= least) | F.col("data"))
    for _ in range(rounds):
        told = _scored(_scored(now.drop("path", "path_sure").withColumn("other", F.col("marked") & ~F.col("data")), "path", "path_words", "other"), "line", "lines", "marked")
        told = told.withColumn("target", F.col("marked") | (F.col("notice") & (F.col("line") > 0)))
        last = keep(_forest(told, [*FEATURES, "path", "path_sure", "line", "line_sure"], "target", fit_rows, trees, depth).withColumn("marked", F.col("p") >= 0.5).withColumnRenamed("p", "probability"))
        now = last.drop("probability", "line", "line_sure", "target", "other")
    return last.select("artifact_id", "notice", "data", "seen", "probability", (~F.col("marked")).alias("handwritten"))
