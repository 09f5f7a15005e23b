"""License scans: normalised text against licence templates, by Dice over word bigrams.

Templates are whole licences and notices, their paragraphs and their sentences; parts that several
licences share stand for none of them. A text's passages are its lines, the sentences and the
paragraphs of its unwrapped text, and the runs of paragraphs that are as long as a licence. Passages
are lower-cased and reduced to their words. Dice of two bigram sets of sizes a and b is at most
2 min(a, b) / (a + b), so with threshold t only templates of t / (2 - t) <= b / a <= (2 - t) / t can
match: the others are pruned before any set is intersected.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let
from .license_texts import TEXTS

THRESHOLD = 0.8
#: In place of a licence, for passages that several have; first of equals.
SHARED = ""
_SENTENCE = r"([.!?:])[ \t]+([A-Z])"


def parts_of(text: str) -> list[str]:
    """A template's passages: the whole, its paragraphs, their sentences."""
    paragraphs = text.split("\n\n")
    return list(dict.fromkeys([" ".join(paragraphs), *paragraphs, *(s for p in paragraphs for s in re.sub(_SENTENCE, "\\1\n\\2", p).split("\n"))]))


def derived(texts: list[tuple[str, str]] = TEXTS, least: int = 2) -> list[tuple[str, str]]:
    """(licence, passage) of all texts, without passages of fewer than `least` bigrams. A passage that several
    licences have stands for SHARED: what is nearest to it says nothing of one licence."""
    found = {(i, " ".join(_words(p))): (i, p) for i, t in texts for p in parts_of(t) if len(_grams(p)) >= least}
    times = Counter(w for _, w in found)
    return [v for (_, w), v in found.items() if times[w] == 1] + list({w: (SHARED, p) for (_, w), (_, p) in found.items() if times[w] > 1}.values())


def words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")), " ")


def bigrams(w: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))


def _words(text: str) -> list[str]:
    return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()


def _grams(text: str) -> list[str]:
    w = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def _share(threshold: float) -> tuple[int, int]:
    """t / (2 - t) in integers: with floats, sizes that just match are lost."""
    t = Fraction(str(threshold))
    return (t / (2 - t)).as_integer_ratio()


def _signals(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which a matching passage has one at least. Dice >= t needs the passage to share t / (2 - t) of
    the template's bigrams, so it cannot miss all of a larger share than the rest: of each template,
    words are taken until they occur in that many of its bigrams. Words that serve many templates,
    long ones first among them, are taken first, so that few words do for all."""
    part, whole = _share(threshold)
    serves: dict[str, int] = defaultdict(int)
    for grams in templates:
        for w in {w for g in grams for w in g.split(" ")}:
            serves[w] += 1
    rank = lambda w: (-min(len(w), 7), -serves[w], -len(w), w)
    taken: set[str] = set()
    for grams in sorted(templates, key=len):
        need = len(grams) + len(grams) * part // -whole + 1
        held = [bool(taken & set(g.split(" "))) for g in grams]
        for w in sorted({w for g in grams for w in g.split(" ")}, key=rank):
            if sum(held) >= need:
                break
            taken.add(w)
            held = [h or w in g.split(" ") for h, g in zip(held, grams)]
    return sorted(taken)


def _runs(texts: list[tuple[str, str]]) -> list[int]:
    """How many paragraphs the texts have that have several."""
    return sorted({len(t.split("\n\n")) for _, t in texts} - {1})


def passages(text: Column, lengths: list[int]) -> Column:
    """The different passages of a text, as their words joined by a space; lengths: of runs of paragraphs."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    cut = lambda c: F.split(F.regexp_replace(c, _SENTENCE, "$1\n$2"), "\n")
    paragraphs = F.transform(F.split(F.regexp_replace(text, r"\r", ""), r"\n[ \t]*\n"), lambda p: F.regexp_replace(p, r"[ \t\n]+", " "))

    def of(p: Column) -> Column:
        runs = [_joined(p, n) for n in lengths]
        return F.array_distinct(F.transform(F.concat(F.flatten(F.transform(F.split(text, "\n"), cut)), F.flatten(F.transform(p, cut)), p, *runs), flat))

    return let(paragraphs, of)


def _joined(p: Column, n: int) -> Column:
    """Every n paragraphs in a row as one passage."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(p, i, F.lit(n)), " "))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] = TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per id of docs and licence found under it: (id, license_id, dice, n_passages).

    texts are licences and notices (blank lines between paragraphs); derived() makes the templates of
    them. A passage counts for its best template if that reaches the threshold (ties: the first licence
    by name); dice is the best of the document's passages, n_passages the number of different ones that
    match; one that is nearest to a passage which several licences share counts for none; a line or paragraph around a matching sentence is a passage of its own and counts too if it matches. Whole texts are read, however long; null and empty texts, and passages of one word, match
    nothing. Repeated ids are reported together, rows without an id as one; passages that several of
    such rows have count per row. An empty table gives no rows; further columns, whatever their names,
    are ignored. Rows meet only in the last grouping, combined per task first, so no text is hot.
    """
    every = [(i, _grams(t)) for i, t in derived(texts)]
    grams = [x for x in every if x[0] != SHARED]
    part, whole = _share(threshold)
    low = -(min(len(g) for _, g in grams) * part // -whole)
    high = max(len(g) for _, g in grams) * whole // part
    signal = r"(?<![a-z0-9])(?:" + "|".join(_signals([g for _, g in grams], threshold)) + r")(?![a-z0-9])"
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.split(F.lit("|".join(g)), "[|]").alias("grams")) for i, g in every])  # constants: folded once
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.lower("text").rlike(signal))
    units = rows.select("id", F.explode(passages(F.col("text"), _runs(texts))).alias("p")).where(F.col("p").rlike(signal)).select("id", F.split("p", " ").alias("w"))
    # A passage of a bigrams has more than a words, and at most a + 1 different ones.
    units = units.where((F.size("w") - 1 >= low) & (F.size(F.array_distinct("w")) - 1 <= high))

    def best(g: Column) -> Column:
        """The best template of a bigram set, if it reaches the threshold: an array of at most one."""
        size = F.size(g)
        fits = F.filter(known, lambda t: (F.size(t["grams"]) * whole >= size * part) & (size * whole >= F.size(t["grams"]) * part))
        dice = F.transform(fits, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect(t["grams"], g)) / (F.size(t["grams"]) + size)).alias("loss"), t["id"].alias("license_id")))
        return F.filter(F.array(F.array_min(dice)), lambda h: h["loss"] <= -threshold)

    # Exploded, not filtered: a filter would be pushed down and work the sets out again for each template.
    hits = units.select("id", F.explode(let(bigrams(F.col("w")), best)).alias("hit")).where(F.col("hit.license_id") != SHARED)
    return hits.groupBy(F.col("id").alias(id_col), F.col("hit.license_id").alias("license_id")).agg(F.max(-F.col("hit.loss")).alias("dice"), F.count("*").alias("n_passages"))


def license_sql(texts: list[tuple[str, str]] = TEXTS, threshold: float = THRESHOLD) -> str:
    """The same for DuckDB over the table documents, without any pruning: all templates against all passages."""
    rows = ", ".join("('" + i + "', [" + ", ".join(f"'{a} {b}'" for a, b in dict.fromkeys(zip(w, w[1:]))) + "])" for i, t in derived(texts) if (w := _words(t)))
    runs = " || ".join(f"list_transform(range(1, greatest(len(ps) - {n} + 1, 1) + 1), lambda i: array_to_string(ps[i:i + {n - 1}], ' '))" for n in _runs(texts))
    cut = lambda c: f"string_split(regexp_replace({c}, '([.!?:])[ \\t]+([A-Z])', '\\1\n\\2', 'g'), '\n')"
    return f"""
WITH known(license_id, tg) AS (VALUES {rows}),
ps AS (SELECT doc_id, text, list_transform(string_split_regex(replace(text, chr(13), ''), '\n[ \t]*\n'), lambda p: regexp_replace(p, '[ \t\n]+', ' ', 'g')) AS ps FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(list_distinct(list_transform(flatten(list_transform(string_split(text, '\n'), lambda c: {cut("c")})) || flatten(list_transform(ps, lambda c: {cut("c")})) || ps || {runs}, lambda c: trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))))) AS p FROM ps),
w AS (SELECT doc_id, row_number() OVER () AS unit, string_split(p, ' ') AS w FROM units),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, unit, license_id, 2.0::double * len(list_intersect(tg, g)) / (len(tg) + len(g)) AS dice FROM g, known),
best AS (SELECT doc_id, unit, min(struct_pack(loss := -dice, license_id := license_id)) AS hit FROM d WHERE dice >= {threshold} GROUP BY doc_id, unit)
SELECT doc_id, hit.license_id AS license_id, max(-hit.loss) AS dice, count(*) AS n_passages FROM best WHERE hit.license_id <> '{SHARED}' GROUP BY ALL"""
