"""Secret scans with DataFrame functions only, and the corpus-wide ownership of what they find.

A kind's matches come from one regular expression, and so do the pieces between
them; lengths of pieces and matches, summed up in order, are the places of the
matches.  Every found value is then counted over the corpus by distinct
repositories and distinct owners: a value that many owners have, in as many
repositories, is an example that was copied around; one that only one or two
have, or that one repository has under several owners, may be a live credential.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_and_rest, join_on_counted, require_columns, whole_row, written

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Header, body and END line are one match.  The END line is sought over at most 8 lone hyphens (headers of encrypted
#: keys have 4); a key cut off before it goes as far as its lines of base64.  The value is all that follows the header.
_BASE64 = "[A-Za-z0-9+/=]"
_PEM = rf"""-----BEGIN [A-Z ]*PRIVATE KEY-----([^-]*(?:-[^-]+){{0,8}}-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\x09-\x0D\\"'>,]*{_BASE64 * 16}{_BASE64}*){{0,400}})"""


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, the least length of the value, and strings of which every match
    holds one (``folded``: in either case), by which most texts are passed over without the pattern."""

    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    holds: tuple[str, ...] = ()
    folded: bool = False

    def found_in(self, text: Column) -> Column:
        seen = F.lower(text) if self.folded else text
        pattern = text.rlike(self.pattern)
        return reduce(or_, (seen.contains(x) for x in self.holds)) & pattern if self.holds else pattern


#: The base kinds in their order, then those that the ownership count adds.  A maximal run of the access
#: and hex alphabets that is too short holds no longer match, so the least length may stand in the pattern.
KINDS = (
    Kind("assign", _ASSIGN, 2, 12, holds=("password", "passwd", "secret", "token", "apikey", "api_key"), folded=True),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, holds=("AKIA",)),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False, holds=("_",)),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False, holds=("xox",)),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, False, holds=("eyJ",)),
    Kind("pem", _PEM, 1, 40, False, holds=("-----BEGIN",)),
)
BASE = tuple(k for k in KINDS if k.base)
#: A value held by this many owners or more, in this many repositories or more, is a copied example.
EXAMPLE_OWNERS = 3
PLACEHOLDER = "[SECRET]"


def _matches(text: Column, order: int, kind: Kind) -> Column:
    """array<struct<kind, nth, gap, len, value>>: gap is the length of the piece before the match."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = found if not kind.group else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    gaps = F.transform(F.split(text, kind.pattern, -1), F.char_length)
    # The piece behind the last match is left out.
    zipped = F.slice(F.arrays_zip(found.alias("f"), values.alias("v"), gaps.alias("g")), 1, F.size(found))
    one = lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), x["g"].alias("gap"), F.char_length(x["f"]).alias("len"), x["v"].alias("value"))
    rows = F.transform(zipped, one)
    return F.when(kind.found_in(text), rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,len:int,value:string>>"))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = None) -> DataFrame:
    """Every match with a long enough value: row (one number for each row of ``docs``), doc_id, repo, owner,
    kind, start, end (code points, end exclusive), cut (where what has to be hidden starts: an assignment's value, the
    whole match else), value_sha256; rows without any have one line with a null kind."""
    require_columns(docs, [c for c in (id_col, text_col, repo_col, owner_col) if c])
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[f"`{id_col}`"].cast("long").alias("doc_id"),
        docs[f"`{repo_col or id_col}`"].cast("string").alias("repo"),
        docs[f"`{owner_col or id_col}`"].cast("string").alias("owner"),
        F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"),
    )
    found = texts.select("row", "doc_id", "repo", "owner", F.concat(*(_matches(F.col("text"), k, kind) for k, kind in enumerate(KINDS))).alias("m"))
    each = found.select("row", "doc_id", "repo", "owner", F.explode_outer("m").alias("m")).select("row", "doc_id", "repo", "owner", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    each = each.withColumn("start", F.col("end") - F.col("len"))
    each = each.withColumn("cut", F.when(F.col("kind") == 0, F.col("end") - F.char_length("value")).otherwise(F.col("start")))
    least = F.element_at(F.array(*(F.lit(k.least) for k in KINDS)), F.col("kind") + 1)
    short = F.char_length("value") < least
    blank = lambda c: F.when(~short, F.col(c)).alias(c)
    return each.select("row", "doc_id", "repo", "owner", blank("kind"), blank("start"), blank("end"), blank("cut"), F.when(~short, F.sha2("value", 256)).alias("value_sha256"))


def ownership(found: DataFrame) -> DataFrame:
    """value_sha256, n_repos, n_owners (distinct ones that aren't null) and n_spans of every value, grouped within tasks first."""
    per = found.where("value_sha256 IS NOT NULL").groupBy("value_sha256", "owner", "repo").agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.lit(True).alias("is_owner"), F.col("owner").alias("name"), F.col("n")), F.struct(F.lit(False).alias("is_owner"), F.col("repo").alias("name"), F.lit(0).cast("long").alias("n")))
    names = per.select("value_sha256", F.explode(both).alias("x")).select("value_sha256", "x.*").groupBy("value_sha256", "is_owner", "name").agg(F.sum("n").alias("n"))
    known = F.col("name").isNotNull()
    return names.groupBy("value_sha256").agg(
        F.count_if(known & ~F.col("is_owner")).alias("n_repos"), F.count_if(known & F.col("is_owner")).alias("n_owners"), F.sum("n").alias("n_spans")
    )


def is_example(owners: int = EXAMPLE_OWNERS) -> Column:
    return F.least("n_owners", "n_repos") >= owners


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.

    The document stands for the repository.  All base spans stay; of the added kinds those are left out
    whose value ``example_owners`` owners or more have, in as many documents.  ``n_live`` counts spans of values that
    fewer have, ``n_examples`` the others.  Null text counts as empty; a null owner is no owner and a null id no
    repository, and a value without an owner counts as live; null and repeated ids stay; an empty table gives an
    empty result.  Other columns are ignored.
    """
    found = written(spans(docs, id_col=id_col, text_col=text_col, owner_col=owner_col), "secret-spans")
    # Rows without a match don't meet the join, where all their nulls would make one key.
    some = found.where("value_sha256 IS NOT NULL")
    owned = written(ownership(found), "secret-owners")
    joined = join_on_counted(some, owned, "value_sha256", "n_spans", some.count()).unionByName(found.where("value_sha256 IS NULL"), allowMissingColumns=True)
    example = F.coalesce(is_example(example_owners), F.lit(False))
    named = F.concat_ws(":", F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), F.col("kind") + 1), F.col("start"), F.col("end"))
    item = F.struct(F.col("start").cast("long").alias("s"), F.col("kind").alias("k"), named.alias("t"))
    is_base = F.col("kind") < len(BASE)
    stays = F.col("kind").isNotNull() & (is_base | ~example)
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), ",")
    rows = joined.groupBy("row", "doc_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{kind.name}") for k, kind in enumerate(BASE)),
        F.collect_list(F.when(is_base, item)).alias("base"),
        F.collect_list(F.when(stays, item)).alias("all"),
        F.count_if(stays & ~example).alias("n_live"),
        F.count_if(F.col("kind").isNotNull() & example).alias("n_examples"),
    )
    return rows.select("doc_id", *(f"n_{k.name}" for k in BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"), "n_live", "n_examples")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", chars_col: str | None = "n_chars", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with every live-looking value replaced by PLACEHOLDER; widely copied examples stay.

    The kinds are sought apart, as in the report, and live values that overlap are replaced as one; of a private key
    all from its header to its END line goes, or what is there of its body.  Owners are counted in the table that is
    given: after deduplication a text that ten owners had counts for the one that kept it.  Rows without a match, null
    texts among them, are passed on as they are; ``chars_col``, if the table has it, is set anew where the text
    changes; null and repeated ids stay; an empty table gives an empty result; other columns stay.
    """
    require_columns(docs, [id_col, text_col, owner_col])
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    hit = reduce(or_, (kind.found_in(text) for kind in sorted(KINDS, key=lambda k: not k.holds)))
    # Written, so that the numbers of the few rows with a match hold in what follows.
    own = docs[f"`{id_col}`"].cast("string").alias("_repo"), docs[f"`{owner_col}`"].cast("string").alias("_owner"), text.alias("_text")
    flagged = written(docs.where(hit).select(F.monotonically_increasing_id().alias("_n"), *own, whole_row(docs)), "secret-rows")
    found = spans(flagged, id_col="_n", text_col="_text", repo_col="_repo", owner_col="_owner")
    found = written(found.where("kind IS NOT NULL").select(F.col("doc_id").alias("_n"), "repo", "owner", "cut", "end", "value_sha256"), "secret-values")
    examples = written(ownership(found).where(is_example(example_owners)), "secret-examples")
    hot, rest = (part.select("value_sha256") for part in hot_and_rest(examples, "n_spans", found.count()))
    live = found.join(F.broadcast(hot), "value_sha256", "left_anti").join(rest, "value_sha256", "left_anti").select("_n", "cut", "end")
    in_row = Window.partitionBy("_n").orderBy("cut", "end")
    before = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    apart = live.withColumn("new", F.when(F.col("cut") < before, 0).otherwise(1)).withColumn("part", F.sum("new").over(in_row.rowsBetween(Window.unboundedPreceding, 0)))
    parts = apart.groupBy("_n", "part").agg(F.min("cut").cast("int").alias("a"), F.max("end").cast("int").alias("b"))
    hidden = parts.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_hidden"))
    joined = flagged.join(hidden, "_n", "left")
    ends = F.concat(F.array(F.lit(0)), F.transform("_hidden", lambda x: x["b"]))
    shown = F.zip_with("_hidden", F.slice(ends, 1, F.size("_hidden")), lambda x, last: F.concat(F.substring(F.col("_text"), last + 1, x["a"] - last), F.lit(PLACEHOLDER)))
    rest = F.substring(F.col("_text"), F.element_at(ends, -1) + 1, F.char_length("_text"))
    changed = F.col("_hidden").isNotNull()
    glued = F.concat(F.array_join(shown, ""), rest)
    kept = lambda c: F.col("_row")[c]
    columns = {text_col: F.when(changed, glued).otherwise(kept(text_col))}
    if chars_col and chars_col in docs.columns:
        columns[chars_col] = F.when(changed, F.char_length(glued).cast(docs.schema[chars_col].dataType)).otherwise(kept(chars_col))
    new = joined.select(*(columns.get(c, kept(c)).alias(c) for c in docs.columns))
    return docs.where(~hit).unionByName(new)
