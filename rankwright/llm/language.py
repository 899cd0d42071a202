"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to the likelihood of the text, the
likelihood of the declared (markup) language, the likelihood of the address
suffix, and the prior of the host.  Host priors are sums of text posteriors by
host, smoothed towards those of the host's suffix, which are smoothed towards
those of the whole table; all come from grouped aggregation, and a document is
left out of its own host's prior.  Texts are scored once, into a written table
that holds no text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, join_on_counted, require_columns, small_batches, whole_row, written
from .located import located, place, without_rows

#: Hash slots of the character trigrams.
SLOTS = 1 << 15
UNKNOWN = "und"
#: Suffix of an address -> languages it speaks for (fixed values).
SUFFIX_LANGUAGES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}
_ASCII_FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Slots of the character trigrams of the lower-cased text; what is no letter in ASCII counts as a space."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(points < 128, _ASCII_FOLD[np.minimum(points, 127)], points)
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]  # one space for many
    if len(points) < 3:
        return np.empty(0, np.int64)
    mixed = (points[:-2] * np.uint32(0x9E3779B1)) ^ (points[1:-1] * np.uint32(0x85EBCA77)) ^ (points[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """Trigram log-likelihoods, one row for each language and a last one for what is none of them."""

    languages: tuple[str, ...]
    table: np.ndarray = field(repr=False)

    def log_likelihoods(self, text: str, weight: int) -> np.ndarray:
        """Mean log-likelihood of a trigram, counted as at most ``weight`` independent trigrams: neighbouring
        trigrams overlap, and a plain sum would let the text shout down all other evidence."""
        slots = trigrams(text)
        if not len(slots):
            return np.zeros(len(self.languages) + 1)
        return self.table[slots].mean(0) * min(len(slots), weight)


def model_of(counts: dict[str, np.ndarray]) -> TextModel:
    """Smoothed frequencies from the trigram counts of each language.

    The row of the unknown language gives each slot the same probability, raised by 0.5: a language has
    to explain a trigram better than that.
    """
    languages = tuple(sorted(counts))
    smooth = [counts[lang] + 0.05 for lang in languages]
    rows = [np.log(c / c.sum()) for c in smooth] + [np.full(SLOTS, np.log(1 / SLOTS) + 0.5)]
    return TextModel(languages, np.ascontiguousarray(np.stack(rows, 1)))


def train(labelled: list[tuple[str, str]]) -> TextModel:
    """The model of (language, text) pairs."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in labelled:
        counts[lang] = counts.get(lang, np.zeros(SLOTS)) + np.bincount(trigrams(text), minlength=SLOTS)
    return model_of(counts)


#: Rows of a label that each task hands on at most: Spark cuts a window's rows before it moves them up to this limit.
MOST_OF_LABEL = 1000


def fit(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample: int = 2000, languages: int = 100) -> TextModel:
    """Train on a bounded sample of labelled rows: the ``languages`` most frequent labels of the whole table get the same
    share of ``sample`` rows each, at most 1,000 a label, those with the least hash of the id.

    Labels are counted over all rows, so that a rare language is learnt as well as a frequent one.  As hashes are spread
    evenly, all but about four times a label's share are passed over by their hash before any are put in order.  The
    trigrams of the sample are counted in the tasks that hold its texts, and only counts come to the driver.  A table
    without labels gives a model that knows no language.
    """
    label, text, key = (docs[f"`{c}`"] for c in (label_col, text_col, id_col))
    hashed = docs.where(label.isNotNull() & text.isNotNull()).select(F.xxhash64(key).alias("h"), F.lower(label).alias("l"), text.cast("string").alias("t"))
    known = hashed.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()
    if not known:
        return model_of({})
    share = max(1, min(MOST_OF_LABEL, sample // len(known)))
    # A label's rows are near if their hash lies in the lowest part of its range, which about 4 * share of them do.
    bounds = docs.sparkSession.createDataFrame([(r.l, -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 4 * share // r.n)) for r in known], "l string, bound long")
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    near = hashed.join(F.broadcast(bounds), "l").where("h <= bound")
    last = near.select("l", "h").withColumn("k", place).where(F.col("k") <= share).groupBy("l").agg(F.max("h").alias("last"))
    picked = near.join(F.broadcast(last), "l").where("h <= last").select("l", "h", "t")
    # Rows that repeat an id have one hash: they are cut off here.
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("k") <= share)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[lang] = total.get(lang, np.zeros(SLOTS, np.int64)) + np.bincount(trigrams(t), minlength=SLOTS)
        for lang, n in total.items():
            slots = np.flatnonzero(n)
            # A language whose texts hold no trigram is known all the same.
            slots = slots if len(slots) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots.astype(np.int32)), pa.array(n[slots])], names=["l", "slot", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in picked.select("l", "t").mapInArrow(count, "l string, slot int, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).collect():  # slots x languages
        counts.setdefault(r.l, np.zeros(SLOTS))[r.slot] = r.n
    return model_of(counts)


def declared_in_markup(html: Column) -> Column:
    """Primary subtag of the lang attribute of the html element, lower-cased; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    """Host of an address, without a leading www."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """What stands behind the last dot of a host; null if there is no dot."""
    last = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return F.when(last != "", last)


@dataclass(frozen=True)
class Evidence:
    """Strengths of the evidence; all are odds or pseudo-counts and hold for any table."""

    text_weight: int = 60
    declared_right: float = 0.9
    suffix_right: float = 0.7
    host_count: float = 10.0
    suffix_count: float = 50.0
    least: float = 0.5


def _host_key(host: Column, suffix: Column) -> Column:
    """One string for each pair of host and suffix, null or not."""
    size = lambda c: F.coalesce(F.char_length(c).cast("string"), F.lit("-"))
    return F.concat(size(host), F.lit(":"), size(suffix), F.lit(":"), F.coalesce(host, F.lit("")), F.coalesce(suffix, F.lit("")))


def _scored(docs: DataFrame, model: TextModel, *, row: Column, text: Column, declared: Column | None, host: Column | None, suffix: Column | None, weight: int) -> DataFrame:
    """_row, _text (log-likelihoods), _post (text posteriors), _declared, _host, _suffix, _key of every row, written."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(texts):
        found = shared.value
        return texts.map(lambda t: found.log_likelihoods(t, weight))

    none = F.lit(None).cast("string")
    host, suffix = host if host is not None else none, suffix if suffix is not None else none
    declared = F.lower(declared) if declared is not None else none
    base = docs.select(row.alias("_row"), likelihoods(F.coalesce(text, F.lit(""))).alias("_text"), declared.alias("_declared"), host.alias("_host"), suffix.alias("_suffix"))
    top = F.array_max("_text")
    base = base.withColumn("_like", F.transform("_text", lambda x: F.exp(x - top)))
    whole = F.aggregate("_like", F.lit(0.0), lambda a, x: a + x)
    base = base.withColumn("_post", F.transform("_like", lambda x: x / whole)).withColumn("_key", _host_key(F.col("_host"), F.col("_suffix")))
    return written(base.drop("_like"), "language-scores")


def host_priors(base: DataFrame, names: int, evidence: Evidence) -> DataFrame:
    """_key, _n, _sums, _by_suffix of every pair of host and suffix: the rows, their text posteriors added up, and the
    suffix's shares, smoothed towards those of the whole table.  Every level is added up from the one below."""
    sums = [F.sum(F.col("_post")[k]).alias(f"s{k}") for k in range(names)]
    hosts = base.groupBy("_key", "_suffix").agg(F.count("*").alias("n"), *sums)
    add = [F.sum(c).alias(c) for c in ("n", *(f"s{k}" for k in range(names)))]
    hosts = written(hosts, "host-sums")
    suffixes = written(hosts.groupBy("_suffix").agg(*add), "suffix-sums")
    few = suffixes.count()
    total = suffixes.agg(*add).select(F.col("n").alias("gn"), *(F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(names)))
    share = lambda k: (F.col(f"g{k}") + 1.0) / (F.coalesce(F.col("gn"), F.lit(0)) + float(names))
    smoothed = F.array(*((F.col(f"s{k}") + evidence.suffix_count * share(k)) / (F.col("n") + evidence.suffix_count) for k in range(names)))
    suffixes = suffixes.join(F.broadcast(total)).select(F.col("_suffix").alias("_x"), smoothed.alias("_by_suffix"))
    # Suffixes are far fewer than hosts, of which the null suffix alone may have all.
    priors = hosts.join(broadcast_if_small(suffixes, few, 64 + 16 * names), hosts["_suffix"].eqNullSafe(suffixes["_x"]))
    return written(priors.select("_key", F.col("n").alias("_n"), F.array(*(f"s{k}" for k in range(names))).alias("_sums"), "_by_suffix"), "host-priors")


def identified_rows(
    docs: DataFrame,
    model: TextModel,
    *,
    row: Column,
    text: Column,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    evidence: Evidence = Evidence(),
) -> DataFrame:
    """For every row of ``docs``: ``row``, a struct of what is to be carried along, and the struct ``language``:
    lang, posterior, text_lang, kept.

    ``lang`` is the language of greatest posterior (ties by name), or "und".  A row is rejected (not kept)
    if that is "und" or the posterior is under ``evidence.least``.  A declared language that the model doesn't know
    speaks for "none of the model's languages", and where that wins it is the row's language.  Null text counts as
    empty and gives no likelihood; a text without letters is "und" unless other evidence speaks; null declarations,
    suffixes and hosts give no evidence.  A model that knows no language rejects nothing.  Repeated rows stay, and
    an empty table gives an empty result.
    """
    names = (*model.languages, UNKNOWN)
    base = _scored(docs, model, row=row, text=text, declared=declared, host=host, suffix=suffix, weight=evidence.text_weight)
    priors = host_priors(base, len(names), evidence)
    # A row for each host: if they are known to be few, the documents need not be moved to meet them; else those of
    # hosts with very many documents, no host among them, stay where they are.
    size = priors.agg(F.coalesce(F.sum(F.octet_length("_key") + 64 + 16 * len(names)), F.lit(0)).alias("b"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()
    small = broadcast_if_small(priors, 1, size.b)
    joined = base.join(small, "_key") if small is not priors else join_on_counted(base, priors, "_key", "_n", size.n)

    known = F.col("_declared").isin(*model.languages) if model.languages else F.lit(False)
    foreign = F.col("_declared").isNotNull() & ~known

    def log_score(k: int) -> Column:
        hosted = F.col("_host").isNotNull()
        own = F.when(hosted, F.greatest(F.col("_sums")[k] - F.col("_post")[k], F.lit(0.0))).otherwise(0.0)
        others = F.when(hosted, F.col("_n") - 1).otherwise(0)
        score = F.col("_text")[k] + F.log((own + evidence.host_count * F.col("_by_suffix")[k]) / (others + evidence.host_count))
        for seen, right in (("_declared", evidence.declared_right), ("_spoken", evidence.suffix_right)):
            wrong = F.lit((1 - right) / max(len(names) - 1, 1))
            speaks = F.col(seen).isin(*model.languages) if model.languages else F.lit(False)
            blank = F.lit(1 / len(names)) if names[k] == UNKNOWN else wrong
            score = score + F.when(speaks, F.log(F.when(F.col(seen) == names[k], F.lit(right)).otherwise(blank))).otherwise(0.0)
        right = evidence.declared_right if names[k] == UNKNOWN else (1 - evidence.declared_right) / max(len(names) - 1, 1)
        return score + F.when(foreign, F.log(F.lit(right))).otherwise(0.0)

    spoken = F.create_map(*(F.lit(x) for kv in SUFFIX_LANGUAGES.items() for x in kv))[F.lower("_suffix")]
    joined = joined.withColumn("_spoken", spoken)
    joined = joined.withColumn("_scores", F.array(*(log_score(k) for k in range(len(names)))))
    best = F.array_max("_scores")
    joined = joined.withColumn("_sum", F.aggregate(F.transform("_scores", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x))
    named = F.array(*map(F.lit, names))
    silent = (F.array_max("_text") == 0.0) & F.col("_declared").isNull() & F.col("_spoken").isNull() & F.col("_host").isNull()
    likeliest = named[F.array_position("_scores", best).cast("int") - 1]
    lang = F.when(silent, F.lit(UNKNOWN)).when(foreign & (likeliest == UNKNOWN), F.col("_declared")).otherwise(likeliest)
    text_lang = F.when(F.array_max("_text") == 0.0, F.lit(UNKNOWN)).otherwise(named[F.array_position("_text", F.array_max("_text")).cast("int") - 1])
    posterior = F.round(1.0 / F.col("_sum"), 6)
    kept = (lang != UNKNOWN) & (posterior >= evidence.least) | F.lit(not model.languages)
    result = F.struct(lang.alias("lang"), posterior.alias("posterior"), text_lang.alias("text_lang"), kept.alias("kept"))
    return joined.select("_row", result.alias("language"))


def identify(docs: DataFrame, model: TextModel, **how) -> DataFrame:
    """``docs`` with the column ``language`` of ``identified_rows``, which replaces one of that name."""
    found = identified_rows(docs, model, row=whole_row(docs), **how)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "language"), "language")


def _documents(docs: DataFrame, row: Column, model: TextModel | None, evidence: Evidence) -> DataFrame:
    require_columns(docs, ["doc_id", "text", "lang", "source"])
    return identified_rows(docs, model or fit(docs), row=row, text=docs["text"], declared=docs["lang"], host=docs["source"], evidence=evidence)


def identify_documents(docs: DataFrame, model: TextModel | None = None, evidence: Evidence = Evidence()) -> DataFrame:
    """Documents: ``lang`` is the declared language and ``source`` the host; sources have no address suffix."""
    found = _documents(docs, whole_row(docs), model, evidence)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != "language"), "language")


def identify_pages(pages: DataFrame, model: TextModel, evidence: Evidence = Evidence()) -> DataFrame:
    """Pages: markup language, address suffix and host come from the html and the url, the text from the html without tags."""
    require_columns(pages, ["url", "html"])
    host = host_of(pages["url"])
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(pages["html"], F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#\w]+;", " ")
    return identify(pages, model, text=plain, declared=declared_in_markup(pages["html"]), host=host, suffix=suffix_of(host), evidence=evidence)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, declared, lang, posterior, text_lang, kept of every document."""
    found = _documents(docs, F.struct(docs["doc_id"], docs["lang"].alias("declared")), None, Evidence())
    return found.select("_row.*", "language.*")


def page_report(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, declared, host, suffix, lang, posterior, text_lang, kept of every page: text, markup language, address suffix
    and host are all heard."""
    require_columns(pages, ["page_id", "url", "html"])
    found = identify_pages(pages.select("page_id", "url", "html"), model)
    host = host_of(F.col("url"))
    return found.select("page_id", declared_in_markup(F.col("html")).alias("declared"), host.alias("host"), suffix_of(host).alias("suffix"), "language.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is known, with their own columns; the others go.

    The rejected rows are known by their places in the table's files, so no text is moved for them to be left out."""
    require_columns(docs, ["doc_id", "text", "lang", "source"])
    docs = located(docs, "language-documents")
    judged = _documents(docs, F.struct(*place()), None, Evidence()).where("NOT language.kept")
    return without_rows(docs, written(judged.select("_row.file", "_row.row"), "language-gone"))
