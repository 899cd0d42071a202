"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule says good (1), bad (0) or nothing (-1).  A document's votes make a
pattern, of which there are at most 3 to the number of rules; documents are
counted by pattern over the whole table, and the expectation-maximisation runs
on these counts.  It estimates, for each rule, how often it is right on good and
on bad documents when it votes, and gives each pattern its posterior probability
of good quality, by which a document is kept.  A rule that abstains says nothing.
Documents that fail the base rule are turned down whatever the rules say, and the
model is fitted on the others.

The likelihood has several peaks, so the maximisation starts from the majority of
votes and once from the bad votes of each rule, and the most probable end counts;
which one that is doesn't hang on the size of the table.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches, written

_WORDLIKE = re.compile(r"[^\W\d_]{2,}")
_LETTER = re.compile(r"[^\W\d_]")
#: Frequent short words of the four languages (fixed values).
FUNCTION_WORDS = frozenset(
    b"the of and to in is it that for on with as are be this by at an or from "
    b"le la les de des du et un une en est que qui pour dans par sur au pas avec "
    b"der die das und den von zu mit ist ein eine im dem nicht auf sich als auch es "
    b"el los las y que del se con por para una su al lo como no".split()
)


def base_features(text: str) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    n_symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        hit = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(windows)] |= hit
        repeat = int(covered.sum())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeat, words


def _band(value: float, good: bool, bad: bool) -> int:
    return 1 if good else 0 if bad else -1


#: Name of each rule; its thresholds are in ``votes``.
RULES = ("length", "repeated_windows", "repeated_lines", "symbols", "word_length", "capitals", "letters", "function_words", "variety")


def votes(text: str, f: tuple) -> list[int]:
    """One vote for each of RULES."""
    n, chars, symbols, dup_lines, repeat, words = f
    if not n:
        return [0] + [-1] * (len(RULES) - 1)
    mean = chars / n
    lines = text.count("\n") + 1
    letters = len(_LETTER.findall(text))
    upper = sum(map(str.isupper, text))
    wordlike = len(_WORDLIKE.findall(text)) / n
    common = sum(w in FUNCTION_WORDS for w in words) / n
    variety = len(set(words)) / n
    return [
        _band(n, n >= 80, n < 50),
        _band(repeat, repeat <= 0.2 * n, repeat > 0.5 * n),
        _band(dup_lines, dup_lines <= 0.1 * lines, dup_lines > 0.3 * lines),
        _band(symbols, symbols <= 0.05 * n, symbols > 0.3 * n),
        _band(mean, 3 <= mean <= 11, mean < 2 or mean > 20),
        _band(upper, upper <= 0.2 * letters, upper > 0.6 * letters),
        _band(wordlike, wordlike >= 0.7, wordlike < 0.4),
        _band(common, common >= 0.1, common < 0.02),
        _band(variety, variety >= 0.3, variety < 0.1),
    ]


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 300, prior_votes: float = 1.0, accuracy: float = 0.75) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, chance of a bad and a good vote [class, rule, bad/good], and a posterior for each pattern.

    Each rule has ``prior_votes`` made-up votes of the given ``accuracy`` in either class.  They keep rules that
    hardly ever vote from running off, and say which of the two classes is the good one.
    """
    good, bad = (patterns == 1).astype(float), (patterns == 0).astype(float)
    rules, total = patterns.shape[1], counts.sum()
    right, wrong = np.full(rules, prior_votes * accuracy), np.full(rules, prior_votes * (1 - accuracy))
    prior_good, prior_bad = np.array([wrong, right]), np.array([right, wrong])

    def climb(posterior: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        for _ in range(rounds):
            weight = np.stack([1 - posterior, posterior], 1) * counts[:, None]
            says_good, says_bad = weight.T @ good + prior_good, weight.T @ bad + prior_bad
            rate = says_good / (says_good + says_bad)
            share = (weight[:, 1].sum() + 4) / (total + 5)
            log = good @ np.log(rate.T) + bad @ np.log(1 - rate.T) + np.log([1 - share, share])
            top = log.max(1, initial=-np.inf)
            each = np.exp(log - top[:, None])
            value = counts @ (top + np.log(each.sum(1))) + (prior_good * np.log(rate) + prior_bad * np.log(1 - rate)).sum() + 4 * np.log(share) + np.log(1 - share)
            moved, posterior = np.abs(each[:, 1] / each.sum(1) - posterior).max(initial=0), each[:, 1] / each.sum(1)
            if moved < 1e-9:
                break
        return float(value), float(share), np.stack([1 - rate, rate], 2), posterior

    starts = [(good.sum(1) + accuracy) / (good.sum(1) + bad.sum(1) + 1)]
    starts += [np.where(bad[:, r] > 0, 0.05, 0.95) for r in range(rules) if bad[:, r].any()]
    _, share, prob, posterior = max(map(climb, starts), key=lambda end: end[0])
    return share, prob, posterior


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality (the posterior), votes (one character for each of RULES: + good, - bad, 0 none).

    Null text has no words and fails the base rule, as any text of under 50 words does; null and repeated
    ids stay; an empty table gives an empty result.  Other columns are ignored.
    """
    require_columns(docs, [id_col, text_col])
    spark = docs.sparkSession
    small_batches(spark)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "votes"]

    def measure(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = base_features(text)
                rows.append((doc, *f[:5], "".join("-+0"[v] for v in votes(text, f))))
            if rows:
                kinds = [*[pa.int64()] * 6, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    measured = written(texts.mapInArrow(measure, ", ".join(f"{n} long" for n in names[:-1]) + ", votes string"), "quality-votes")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # What the base rule turns down needs no verdict, so it doesn't shape the model.  At most 3 ** len(RULES) rows.
    counted = measured.groupBy("votes").agg(F.count_if(~base).alias("n")).orderBy("votes").collect()
    good: list[float] = []
    if counted:
        patterns = np.array([["-+0".index(c) if c != "0" else -1 for c in r.votes] for r in counted])
        good = np.round(fit_label_model(patterns, np.array([r.n for r in counted], float))[2], 9).tolist()
    posteriors = spark.createDataFrame([(r.votes, q) for r, q in zip(counted, good)], "votes string, quality double")
    scored = measured.join(F.broadcast(posteriors), "votes").withColumn("base_failed", base)
    return scored.select(*names[:-1], "base_failed", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"), "quality", "votes")
