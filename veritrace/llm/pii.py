"""Personal data in texts: fixed formats plus scored candidates, in Spark expressions only.

The fixed formats (email, ip, card, phone) are always found. Beside them, high-recall generators
propose spans that may overlap; boosted trees score their format and context, and a threshold per
kind, calibrated on held-out rows, selects which are added.

The trees learn from planted examples: in a bounded sample of the texts' own passages, secrets,
national numbers and disguised addresses are put, and beside them things that look alike but are none
(paths, identifiers, digests, dates, amounts, sentences with an @). A candidate's label is what was
planted where it stands: no feature holds it. The fitted trees become one CASE expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import blocks, cut, let, starts

#: The fixed formats. Possessive and anchored where that cannot change a match, so that neither the
#: stack nor the time grows with long runs of one class.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of candidates: (kind, pattern), in the order in which they win where they overlap.
GENERATORS = [
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}"),
    ("handle", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,}+"),
    ("number", r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){7,}+"),
]
#: Planted examples of each kind, in expectation and at most: a bound on what is learned from, whatever the table.
EXAMPLES, MOST_EXAMPLES = 3000, 6000
TREES, RATE, PRECISION = 40, 0.3, 0.97
_CONTEXT = 24
_SECRET_WORDS = r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key)[^\n]{0,12}$"
_DIGEST_WORDS = r"(?i)(?:commit|sha[0-9-]*|md5|hash|digest|checksum|revision)[^\n]{0,6}$"
_CONTACT_WORDS = r"(?i)(?:tel|phone|call|mobile|fax|mail|contact|reach|ssn)[^\n]{0,12}$"
_DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|ch|at)$"
_DATE = r"^(?:19|20)[0-9]{2}[-./]?[01][0-9][-./]?[0-3][0-9]|^[0-3]?[0-9][-./][01]?[0-9][-./](?:19|20)[0-9]{2}"
FEATURES = ["length", "digits", "upper", "lower", "marks", "hexadecimal", "runs", "most_digits", "groups", "first_group", "last_group", "dashes", "dots", "spaces", "distinct", "prefix", "domain", "bracketed", "sentence", "date", "secret_word", "digest_word", "contact_word", "quoted", "left_mark", "right_mark"]


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, end, s>> in code points."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = F.transform(F.filter(parts, lambda p: p["hit"].isNotNull()), lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("n"), p["hit"].alias("hit")))

    def placed(p: Column) -> Column:
        begin = starts(F.transform(p, lambda x: x["gap"] + x["n"]))
        return F.zip_with(p, begin, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["hit"].alias("s")))

    return let(parts, placed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = _digits(s)
    n = F.length(d)

    def value(i: Column) -> Column:
        x = F.substr(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: a + b)
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """Of each kind, the matches of its fixed format that pass its test."""
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    gated = lambda gate, pattern: F.when(gate, find_all(text, pattern)).otherwise(none)
    number = text.rlike("[0-9]")
    return {
        "email": gated(text.contains("@"), EMAIL),
        "ip": F.filter(gated(number & text.contains("."), IP), lambda m: F.forall(F.split(m["s"], r"\."), _small)),
        "card": F.filter(gated(number, CARD), lambda m: _luhn(m["s"])),
        "phone": F.filter(gated(text.contains("+"), PHONE), lambda m: F.length(_digits(m["s"])).between(8, 15)),
    }


def _without(s: Column, pattern: str) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, pattern, ""))


def _features(m: Column) -> list[Column]:
    """m: the span's text s, and what stands left and right of it."""
    s, left, right = m["s"], m["left"], m["right"]
    flag = lambda c: F.when(c, 1).otherwise(0)
    groups = F.transform(F.filter(F.split(s, "[^0-9]+"), lambda g: g != ""), lambda g: F.length(g))
    values = [
        F.length(s), _without(s, "[0-9]"), _without(s, "[A-Z]"), _without(s, "[a-z]"), _without(s, "[^A-Za-z0-9]"), flag(s.rlike("^[0-9a-fA-F]+$")),
        F.length(F.regexp_replace(s, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]", "x")), F.coalesce(F.array_max(groups), F.lit(0)), F.size(groups), F.coalesce(F.get(groups, F.lit(0)), F.lit(0)), F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(0)),
        _without(s, "-"), _without(s, r"\."), _without(s, " "), F.size(F.array_distinct(F.split(F.substring(s, 1, 64), ""))), flag(s.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-|eyJ|AIza|glpat-)")),
        flag(s.rlike(_DOMAINS)), flag(s.rlike(r"[(\[](?:at|dot)[)\]]")), flag(s.rlike(r"[.] +[A-Za-z]")), flag(s.rlike(_DATE)),
        flag(left.rlike(_SECRET_WORDS)), flag(left.rlike(_DIGEST_WORDS)), flag(left.rlike(_CONTACT_WORDS)), flag(left.rlike("[\"'`=:]\\s?$")), flag(left.rlike(r"[A-Za-z0-9/.,$€£#@-]$")), flag(right.rlike(r"^(?:[A-Za-z%€/-]|[.,:][0-9]| ?(?:kg|km|eur|usd|%))")),
    ]
    return [v.cast("int").alias(n) for n, v in zip(FEATURES, values)]


def _described(held: Column, m: Column, kind: int) -> Column:
    """A candidate of a text, given by its blocks, with its features."""
    near = F.struct(m["s"].alias("s"), cut(held, F.greatest(m["start"] - _CONTEXT, F.lit(0)), F.least(m["start"], F.lit(_CONTEXT))).alias("left"), cut(held, m["end"], F.lit(8)).alias("right"))
    return let(near, lambda x: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), *_features(x)))


def candidates(text: Column) -> Column:
    of = lambda held, kind: lambda m: _described(held, m, kind)
    found = lambda held: F.concat(*[F.transform(find_all(text, GENERATORS[k][1]), of(held, k)) for k in range(len(GENERATORS))])
    return F.when(text.rlike(r"[0-9@]|[\[(]at[\])]"), let(blocks(text), found)).otherwise(F.array().cast(_CANDIDATE))


_CANDIDATE = "array<struct<kind:int,start:int,end:int," + ",".join(f"{n}:int" for n in FEATURES) + ">>"


def _meets(spans: Column, c: Column) -> Column:
    """Whether one of these spans, sorted and apart from each other, overlaps c. A search by halves for
    how many begin before c ends; the last of them ends last. No span is looked at for most candidates."""
    n = F.size(spans)

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        before = F.get(spans, mid - 1)["start"] < c["end"]
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & before, mid).otherwise(s["lo"]).alias("lo"), F.when(go & ~before, mid - 1).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.length(F.bin(n)))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), half)["lo"]
    return F.when(n > 0, F.coalesce(F.get(spans, found - 1)["end"] > c["start"], F.lit(False))).otherwise(False)


class Boosted:
    """Logistic boosting of depth-3 trees over integer features, one model per kind."""

    def __init__(self):
        self.models: dict[int, tuple[float, list]] = {}
        self.threshold: dict[int, float] = {}

    @staticmethod
    def _leaf(g: np.ndarray, h: np.ndarray) -> float:
        return float(g.sum() / (h.sum() + 1.0))

    @classmethod
    def _split(cls, x, g, h):
        """The cut that gains most, from sums of g and h per value of each feature."""
        best = (0.0, None, None)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for j in range(x.shape[1]):
            values, place = np.unique(x[:, j], return_inverse=True)
            if len(values) < 2:
                continue
            a, b = np.cumsum(np.bincount(place, g))[:-1], np.cumsum(np.bincount(place, h))[:-1]
            gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - base
            at = int(gain.argmax())
            if gain[at] > best[0] + 1e-9:
                best = (float(gain[at]), j, float(values[at]))
        return best

    def _tree(self, x, g, h, depth=3):
        _, j, cut = self._split(x, g, h) if depth and len(x) >= 8 else (0, None, None)
        if j is None:
            return self._leaf(g, h)
        left = x[:, j] <= cut
        return (j, cut, self._tree(x[left], g[left], h[left], depth - 1), self._tree(x[~left], g[~left], h[~left], depth - 1))

    @classmethod
    def _apply(cls, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, a, b = tree
        return np.where(x[:, j] <= cut, cls._apply(a, x), cls._apply(b, x))

    def fit(self, kind: int, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        if len(y) < 20 or y[~held].min(initial=1) == y[~held].max(initial=0) or not held.any():
            return
        mean = float(np.clip(y[~held].mean(), 1e-3, 1 - 1e-3))
        bias, trees = float(np.log(mean / (1 - mean))), []
        score = np.full(len(y), bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(x[~held], (y - p)[~held], (p * (1 - p))[~held])
            score += RATE * self._apply(tree, x)
            trees.append(tree)
        order = np.argsort(-score[held], kind="stable")
        s, right = score[held][order], np.cumsum(y[held][order])
        good = np.flatnonzero((right / np.arange(1, len(s) + 1) >= PRECISION) & np.append(s[1:] < s[:-1], True))
        if len(good):
            self.models[kind], self.threshold[kind] = (bias, trees), float(s[good[-1]])

    @classmethod
    def _sql(cls, tree, c: Column) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        j, cut, a, b = tree
        return F.when(c[FEATURES[j]] <= F.lit(int(cut)), cls._sql(a, c)).otherwise(cls._sql(b, c))

    def selects(self, c: Column) -> Column:
        out = F.lit(False)
        for kind, (bias, trees) in self.models.items():  # integer features: a cut is a whole number
            total = F.lit(bias)
            for tree in trees:
                total = total + RATE * self._sql(tree, c)
            out = F.when(c["kind"] == kind, total >= self.threshold[kind] - 1e-9).otherwise(out)
        return out


def _examples(kind: str, seed: int) -> list[tuple[int, str, str, str]]:
    """(label, before, SQL of what is planted, after) of each form, over the columns key and words."""

    def drawn(i: int) -> str:
        return "concat(" + ", ".join(f"sha2(concat(key, ':{seed}:{i}:{j}'), 256)" for j in range(2)) + ")"

    hexa = lambda i, n: f"substr({drawn(i)}, 1, {n})"
    digits = lambda i, n: f"translate({hexa(i, n)}, 'abcdef', '185294')"
    mixed = lambda i, n: f"substr(translate(base64(unhex({drawn(i)})), '+/=\r\n', 'pQx'), 1, {n})"
    # Parts of a form: 'text' as it is, and SQL for the rest.
    put = lambda *parts: "concat(" + ", ".join(parts) + ")"
    t = lambda text: f"'{text}'"
    a, b, c, d = (f"get(words, cast(pmod(key + {7 * i}, size(words)) as int))" for i in range(4))
    if kind == "secret":
        return [
            (1, 'token = "', hexa(0, 40), '"'), (1, "password: ", mixed(0, 24), ""), (1, "", put(t("AKIA"), f"upper({mixed(0, 16)})"), ""), (1, "api_key=", hexa(0, 32), ""), (1, "", put(t("ghp_"), mixed(0, 36)), ""),
            (1, "Bearer ", mixed(0, 40), ""), (1, "", put(mixed(0, 43), t("=")), ""), (1, "secret ", hexa(0, 64), ""), (1, "access_key: '", mixed(0, 40), "'"), (1, "", put(t("sk-"), mixed(0, 48)), ""), (1, "auth token is ", mixed(0, 32), ""),
            (0, "", put(a, t("_"), b, t("_"), c, t("_"), d, t("_value2")), ""), (0, "https://", put(a, t("/2024/"), b, t("-"), c, t("/page3/"), d, t("/index")), ""), (0, "", f"repeat({digits(1, 1)}, 24)", ""), (0, "", digits(0, 22), ""),
            (0, "", put(t("2024-01-"), digits(0, 2), t("-"), a, t("-"), b, t("-"), c), ""), (0, "token ", put(a, b, c, d, t("abcdefghij"), digits(0, 1)), ""), (0, "", put(t("v1"), "repeat('-', 24)"), ""), (0, "commit ", hexa(0, 40), ""), (0, "sha256:", hexa(0, 64), ""),
            (0, "md5 ", hexa(0, 32), ""), (0, "class=", put(a, t("-"), b, t("-"), c, t("-"), d, t("-col3")), ""), (0, "import ", put(*(f"initcap({x})" for x in (a, b, c, d)), t("FactoryV2")), ""),
        ]
    if kind == "handle":
        name, host = put(a, digits(0, 2)), put(b, t("x"))
        return [
            (1, "", put(name, t(" (at) "), host, t(" (dot) com")), ""), (1, "", put(name, t(" [at] "), host, t(" [dot] org")), ""), (1, "", put(a, t(" @ "), host, t(".com")), ""), (1, "mail ", put(name, t("(at)"), host, t(".de")), ""),
            (1, "", put(a, t("."), c, t("[at]"), host, t("[dot]net")), ""), (1, "contact: ", put(a, t(" @"), host, t(".info")), ""), (1, "", put(name, t(" (at) "), host, t(".fr")), ""),
            (0, "", put(a, t(" @ "), b, t("x. "), f"initcap({c})", t("q")), ""), (0, "", put(a, t(" @"), b, t("x. "), c, t("q")), ""), (0, "sold ", put(a, t(" @ "), digits(0, 2), t(". "), c, t("q")), ""), (0, "(", put(a, t(" (at) "), b, t("x. "), f"initcap({c})", t("q")), ""),
            (0, "", put(t("3 @ 5. "), f"initcap({a})", t("q")), ""), (0, "see ", put(a, t(" [at] "), b, t("x . "), c, t("q")), ""),
        ]
    return [
        (1, "", put(t("("), digits(0, 3), t(") "), digits(1, 3), t("-"), digits(2, 4)), ""), (1, "", put(digits(0, 3), t("-"), digits(1, 3), t("-"), digits(2, 4)), ""), (1, "Tel. ", put(t("0"), digits(0, 3), t(" "), digits(1, 7)), ""),
        (1, "call ", put(digits(0, 3), t("."), digits(1, 3), t("."), digits(2, 4)), ""), (1, "", put(digits(0, 3), t("-"), digits(1, 2), t("-"), digits(2, 4)), ""), (1, "phone ", put(t("0"), digits(0, 9)), ""), (1, "", put(t("(0"), digits(0, 2), t(") "), digits(1, 8)), ""),
        (1, "mobile: ", put(t("0"), digits(0, 2), t(" "), digits(1, 3), t(" "), digits(2, 4)), ""),
        (0, "", put(t("20"), "lpad(cast(pmod(key, 30) as string), 2, '0')", t("-0"), f"translate({digits(0, 1)}, '0', '1')", t("-1"), digits(1, 1)), ""), (0, "", put(t("20"), digits(0, 2), t("011"), digits(1, 1)), ""), (0, "", put(digits(0, 1), t("."), digits(1, 10)), ""),
        (0, "", digits(0, 8), ""), (0, "", digits(0, 12), ""), (0, "", digits(0, 16), ""), (0, "$", put(digits(0, 3), t("."), digits(1, 3), t("."), digits(2, 3)), ""), (0, "ISBN ", put(t("978-"), digits(0, 1), t("-"), digits(1, 4), t("-"), digits(2, 4), t("-"), digits(3, 1)), ""),
        (0, "", put(*(x for i in range(5) for x in (digits(i, 2), t(" "))), digits(5, 2)), ""), (0, "no ", digits(0, 10), ""), (0, "", put(t("20"), digits(0, 6), t(" "), digits(1, 6)), ""), (0, "", digits(0, 9), " kg"),
        (0, "", put(*(x for i in range(8) for x in (digits(i, 1), t(" "))), digits(8, 1)), ""),
    ]


def planted(texts: DataFrame, kind: int, seed: int, each: int = 1) -> DataFrame:
    """texts: (text). `each` passages of every text with an example of the kind: (text, start, end,
    label, key, of). Place, form and content are fixed by a hash of text and seed; of is the kind."""
    rows = texts.select("text", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("i")).withColumn("key", F.xxhash64("text", "i", F.lit(seed + kind)))
    at = F.pmod(F.col("key"), F.greatest(F.length("text") - 100, F.lit(0)) + 1).cast("int")
    rows = rows.select("key", F.substr("text", at + 1, F.lit(50)).alias("left"), F.substr("text", at + 51, F.lit(50)).alias("right"))
    rows = rows.withColumn("words", F.array_append(F.filter(F.split(F.lower("left"), "[^a-z]+"), lambda w: F.length(w) > 2), F.lit("sample")))
    forms = _examples(GENERATORS[kind][0], seed)
    quote = lambda s: "'" + s.replace("'", "\\'") + "'"
    each_form = " ".join(f"when {n} then named_struct('label', {label}, 'before', {quote(before)}, 's', {made}, 'after', {quote(after)})" for n, (label, before, made, after) in enumerate(forms))
    rows = rows.select("key", "left", "right", F.expr(f"case cast(pmod(xxhash64(key), {len(forms)}) as int) {each_form} end").alias("x"))
    lead = F.concat("left", F.lit(" "), F.col("x.before"))
    return rows.select(F.concat(lead, F.col("x.s"), F.col("x.after"), F.lit(" "), F.col("right")).alias("text"), F.length(lead).alias("start"), (F.length(lead) + F.length("x.s")).alias("end"), F.col("x.label").alias("label"), "key", F.lit(kind).alias("of"))


def _labelled(rows: DataFrame) -> DataFrame:
    """planted rows' candidates of their kind where the example stands, unless a fixed format holds there."""
    spans = base_spans(F.col("text"))
    both = F.struct(candidates(F.col("text")).alias("c"), *[v.alias(k) for k, v in spans.items()])
    here = let(both, lambda x: F.filter(x["c"], lambda c: (c["kind"] == F.col("of")) & (c["start"] < F.col("end")) & (F.col("start") < c["end"]) & ~reduce(lambda a, b: a | b, [_meets(x[k], c) for k in spans])))
    return rows.select("key", "label", F.explode(here).alias("c"))


def fit(docs: DataFrame, text_col: str = "text", seed: int = 1) -> Boosted:
    """Fits on about EXAMPLES planted examples of each kind, MOST_EXAMPLES at most, in passages of texts
    that a hash chooses. A quarter of them, by hash, is held out for the thresholds. A table without
    a row gives a model that selects nothing."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model, n = Boosted(), docs.count()
    if not n:
        return model
    share = min(1.0, EXAMPLES / n)
    texts = texts.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct()
    rows = [planted(texts, kind, seed, max(1, round(EXAMPLES / (n * share)))) for kind in range(len(GENERATORS))]
    got = _labelled(reduce(DataFrame.union, rows)).select("key", "label", "c.*").orderBy("key", "start").limit(MOST_EXAMPLES * len(GENERATORS)).collect()
    for kind in range(len(GENERATORS)):
        own = [r for r in got if r["kind"] == kind]
        x = np.array([[r[f] for f in FEATURES] for r in own], float).reshape(-1, len(FEATURES))
        model.fit(kind, x, np.array([r["label"] for r in own], float), np.array([(r["key"] >> 9) % 4 == 3 for r in own], bool))
    return model


def _of_kind(k: int) -> Column:
    return F.filter("chosen", lambda c: c["kind"] == k)


def _clear(k: int):
    """Of kind k: overlaps none that is chosen of an earlier kind."""
    return lambda c: ~reduce(lambda a, b: a | b, [_meets(F.col(f"chosen_{j}"), c) for j in range(k)], F.lit(False))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Boosted | None = None) -> DataFrame:
    """One row per row of docs: (id, email, ip, card, phone, added), arrays of spans.

    email, ip, card and phone are arrays of struct<start, end, s> in code points (end exclusive), in
    text order; added is an array of struct<kind, start, end>: selected candidates that overlap no
    base span and none of a kind that comes before theirs in GENERATORS, by kind and start. Whole
    texts are read, however long, with work in proportion to their length; null counts as empty and
    has no span. Repeated rows and rows without an id are treated row by row; an empty table gives no
    rows; further columns, whatever their names, are ignored. Rows never meet, so no key can be hot.
    """
    model = model or fit(docs, text_col)
    text = F.col("text")
    out = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({k: v for k, v in base_spans(text).items()} | {"proposed": candidates(text)})
    chosen = F.filter("proposed", lambda c: model.selects(c) & ~reduce(lambda a, b: a | b, [_meets(F.col(k), c) for k in ("email", "ip", "card", "phone")]))
    out = out.withColumn("chosen", F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    # Spans of one generator are apart from each other and in order.
    out = out.withColumns({f"chosen_{k}": _of_kind(k) for k in range(len(GENERATORS))})
    first = F.concat(*[F.filter(f"chosen_{k}", _clear(k)) for k in range(len(GENERATORS))])
    name = F.array(*[F.lit(n) for n, _ in GENERATORS])
    return out.select(id_col, "email", "ip", "card", "phone", F.transform(first, lambda c: F.struct(F.get(name, c["kind"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("added"))


def listed(spans: Column, kind: str) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))
