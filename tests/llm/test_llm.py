"""The text operators against brute force, on a small table of hard rows."""

import hashlib
import html
import re
import textwrap
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrace.llm import chat_format, common, components, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, license_scan, packing, pii, queries, substring_dedup

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(50))
HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "One TWO"), (7, LONG), (8, LONG + " end"), (9, PASSAGE), (10, "a b " + PASSAGE + " c"),
    (11, "x " * 80), (12, "12 - !!"), (13, "Ünï çödé\x0bword joined"), (13, "Ünï çödé\x0bword joined"), (None, "one two"), (None, None), (14, "mail a@b.co or 10.0.0.1, +1 (377) 555-0271 and 4111 1111 1111 1111."),
    (15, "y" * 50_000), (16, "<|endoftext|> a  b\n\n c "),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "en", "s", "extra", 0) for i, t in HARD], "doc_id long, text string, lang string, source string, h string, mark int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def multiset(rows):
    return Counter(map(repr, rows))


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_substring_dedup(request, name):
    frame = request.getfixturevalue(name)
    rows = [(r.doc_id, words(r.text)) for r in frame.collect()]
    k = substring_dedup.WINDOW
    count = Counter(tuple(w[i : i + k]) for _, w in rows for i in range(len(w) - k + 1))
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if count[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    assert multiset(tuple(r) for r in substring_dedup.substring_dedup(frame).collect()) == multiset(want)


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_exact_dedup(request, name):
    frame = request.getfixturevalue(name)
    groups = defaultdict(list)
    for r in frame.collect():
        groups[r.text or ""].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert multiset(tuple(r) for r in exact_dedup.exact_dedup(frame).collect()) == multiset(want)


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        v = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (exact_dedup.golomb_decode(len(v), *exact_dedup.golomb_encode(v)) == v).all()


def near(spark):
    base = [f"t{i}" for i in range(60)]
    rows = [(100 + n, " ".join(x if i not in (n, n + 7) or n % 3 == 0 else f"z{n}" for i, x in enumerate(base))) for n in range(12)]
    return spark.createDataFrame(rows + [(i, t) for i, t in HARD if i != 15], "doc_id long, text string")


@pytest.mark.parametrize(("name", "split"), [("near", jaccard_join.SPLIT), ("near", 0), ("docs", jaccard_join.SPLIT), ("docs", 1)])
def test_jaccard_join(spark, docs, name, split):
    """split: how long a list must be to be dealt over parts."""
    frame = docs if name == "docs" else near(spark).withColumns({"h": F.lit("x"), "uid": F.lit(1), "sig": F.lit(None)})
    rows = []
    for r in frame.collect():
        w = words((r.text or "").translate({i: i + 32 for i in range(65, 91)}))
        rows.append((r.doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    want = [(d, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, s) in enumerate(rows)]
    assert multiset(tuple(r) for r in jaccard_join.jaccard_components(frame, split_at=split).collect()) == multiset(want)


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components(spark, one_task):
    rng = np.random.default_rng(2)
    edges = [(i + 1, i) for i in range(50)] + [(200, i) for i in range(190, 200)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 300, (200, 2))] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u long, v long"), one_task).collect())
    assert got == {x: find(x) for x in list(parent)}


def test_language(spark, docs, hard):
    learned = docs.where(~language_id.held_out())
    network = language_id.fit(learned, docs.text, docs.lang)
    out = language_id.identify(docs, network=network).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r.lang == r.lang_pred for r in out if r.held_out]
    assert sum(held) >= 0.95 * len(held)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(hard, network=network).collect()}
    assert all((got[i] == "und") == (not any(c.isalpha() for c in t or "")) for i, t in HARD if i is not None)
    assert {r.lang_pred for r in language_id.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(0)
    gru = language_id.Gru(rng, 3)
    x = rng.integers(0, 5, (6, 4)).astype(np.uint8)
    mask = np.ones((6, 4, 1), np.float32)
    weight = rng.standard_normal((6, 4, 3)).astype(np.float32)
    _, kept = gru.forward(x, mask, True)
    grads = gru.backward(x, mask, kept, weight)
    for table, grad in zip([*gru.x, *gru.u], grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        ends = []
        for e in (1e-2, -1e-2):
            table[at] += e
            ends.append(float((gru.forward(x, mask) * weight).sum()))
            table[at] -= e
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[at]) < 0.05 * abs(grad[at]) + 1e-2


def test_licenses(spark):
    texts = dict(reversed(license_scan.TEXTS))
    mit = next(t for i, t in license_scan.TEXTS if i == "MIT" and "Permission" in t)
    bsd2, bsd3 = (next(t for i, t in license_scan.TEXTS if i == n and "Redistribution" in t) for n in ("BSD-2-Clause", "BSD-3-Clause"))
    wrap = lambda t: "\n\n".join(textwrap.fill(p, 78) for p in t.split("\n\n"))
    rows = [
        (1, "Intro text.\nReleased under the MIT License."), (2, "It is licensed under the Apache License, version 2.0. More."), (3, None), (4, ""), (5, "MIT"), (6, "nothing of the kind"), (1, "Released under the MIT License."),
        (7, "Some prose here.\n\n" + wrap(mit) + "\n\nThe end."), (8, "Title\n\n" + wrap(bsd2)), (9, wrap(bsd3) + "\n\nmore"), (10, "Before it. " + " ".join(mit.split()) + " After it."), (11, wrap(texts["GPL-3.0"])), (12, "long " * 50_000 + "\n\n" + wrap(mit)), (None, "Released under the MIT License."), (13, "This software is good software, and it is provided here."),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, g int")
    got = {(r.doc_id, r.license_id): (r.dice, r.n_passages) for r in license_scan.license_scan(frame).collect()}
    assert got[1, "MIT"] == (1.0, 3) and got[2, "Apache-2.0"][1] == 2 and got[None, "MIT"] == (1.0, 1)  # a sentence, and the line it is in
    assert {i for i, _ in got} == {1, 2, 7, 8, 9, 10, 11, 12, None}
    assert {x for i, x in got if i in (7, 10, 12)} == {"MIT"} and got[7, "MIT"][0] == 1.0
    assert {x for i, x in got if i == 9} == {"BSD-3-Clause"} and {x for i, x in got if i == 11} == {"GPL-3.0"} and got[8, "BSD-2-Clause"][0] == 1.0


def test_licenses_against_all_templates(spark):
    """Pruning loses nothing: the SQL compares everything with everything. Passages around the threshold."""
    rng = np.random.default_rng(3)
    rows = [(1, "CC BY-NC 4.0"), (2, "Code.\nCC BY-SA 4.0\nMore.")]
    for n, (_, t) in enumerate(license_scan.derived()):
        w = t.split()
        for k in range(3):
            keep = [x if rng.random() > 0.04 * (k + 1) else "changed" for x in w]
            rows.append((100 + 10 * n + k, "Words before.\n" + " ".join(keep) + ("\n\nand after" if k else "")))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = multiset((r.doc_id, r.license_id, round(r.dice, 9), r.n_passages) for r in license_scan.license_scan(frame).collect())
    assert got == multiset((a, b, round(d, 9), n) for a, b, d, n in c.execute(license_scan.license_sql()).fetchall())


def test_chat(spark):
    turns = [(1, 0, "user", "a\\1<s>[+]"), (1, 1, "user", None), (1, 2, "assistant", "</s>[x]"), (1, 3, "assistant", "\\\\0"), (2, None, None, ""), (None, 0, "assistant", "z")]
    out = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.l) for r in out.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert got == {1: ([("user", "a\\1<s>[+]"), ("user", ""), ("assistant", "</s>[x]"), ("assistant", "\\\\0")], "</s>[x]\\\\0"), 2: ([("", "")], ""), None: ([("assistant", "z")], "z")}


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_packing(request, name):
    from tokenizers import Tokenizer

    frame = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (0,)) for r in frame.collect())
    pieces = packing.pack(frame).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, tuple(ids.tolist())))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for sequence in by_sequence.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    for (doc, ids), times in want.items():
        if list(d for d, _ in want.elements()).count(doc) == 1:
            assert sum((x for _, x in sorted(by_doc[doc])), ()) == ids
    assert sum(p.length for p in pieces) == sum(len(i) * n for (_, i), n in want.items())


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "Tom buys 3 kg of apples for 12 dollars and eats 3 of them before dinner with Anna today"), (2, "too short"), (3, None)], "item_id long, text string")
    same = "Intro here: tom buys 3 kg of apples for 12 dollars and eats 3 of them before dinner with Anna today."
    other = "Today Tom buys 7 kg of apples for 40 dollars and eats 7 of them before dinner with Berta today"
    mixed = "Today Tom buys 7 kg of apples for 40 dollars and eats 9 of them before dinner with Berta today"
    docs = spark.createDataFrame([(1, same), (2, other), (3, mixed), (4, None), (5, "and now for something else entirely, again and again"), (6, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.decontaminate(docs, bench).collect()}
    assert (1, 1) in got and got.get((2, 1)) is False and not {d for d, _ in got} & {3, 4, 5, 6}


def test_decontamination_per_occurrence(spark):
    text = "Tom buys {} kg of apples for {} dollars and eats {} of them before dinner with {} today"
    leak, variant, mixed = text.format(3, 12, 3, "Anna"), text.format(7, 40, 7, "Berta"), text.format(7, 40, 9, "Berta")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(1, f"Some words. {leak}. Then more. {variant}."), (2, f"{variant}. {variant.replace('7', '8')}. {mixed}"), (3, f"{mixed}. Then {mixed}"), (4, f"{leak} {mixed} of apples for 99 dollars and eats 3 of them before")]
    got = {r.doc_id: r.exact for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False, 4: True}


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "%")


def template(text):
    """(kind, word) of each word, kind 0 for a literal, and the words with the marks before them."""
    out, marks, last, end = [], (), None, 0
    for m in _WORD.finditer(text or ""):
        opens = last is None or last[-1] in ".!?:" or "\n" in text[end : m.start()]
        last, end = m[0], m.end()
        bare = m[0].strip(_EDGE)
        if not bare:
            marks += (m[0],)
            continue
        number = any(c in "0123456789" for c in bare)
        unit = bool(out) and out[-1][0] == 1 and not number and bare.lower() in decontaminate.UNITS
        name = "A" <= bare[0] <= "Z" and not opens and not number and not unit
        out.append((1 if number else 2 if unit else 3 if name else 0, bare.lower(), marks))
        marks = ()
    return out


def windows_of(words, k):
    for i in range(len(words) - k + 1):
        w = words[i : i + k]
        raw = sum(x[0] == 0 for x in w) < min(decontaminate.LITERAL, k - k // 3)
        yield i, raw, (w[0][1], *(x[1:] for x in w[1:])) if raw else tuple(x[0] or x[1] for x in w), [x[1] if x[0] else None for x in w]


def leaks(doc, item, coverage=decontaminate.COVERAGE):
    """Whether an item is found in a document, and with its own values, by trying every group of hits."""
    words = template(item)
    k = min(decontaminate.K, len(words))
    if not k:
        return None
    own, held = list(windows_of(words, k)), list(windows_of(template(doc), k))
    hits = [(p, d, raw, a, b) for p, raw, key, a in own for d, raw_d, key_d, b in held if (raw, key) == (raw_d, key_d)]
    of, of_template = len({p for p, *_ in own}), len({p for p, raw, *_ in own if not raw})
    plain = [h for h in hits if not h[2]]
    found = exact = False
    if plain:
        shifts, radius = [d - p for p, d, *_ in plain], 0
        while True:
            for anchor in shifts:
                near = [h for h, s in zip(plain, shifts) if abs(s - anchor) <= radius]
                if len({h[0] for h in near}) >= coverage * of_template:
                    pairs = {(x, y) for _, _, _, a, b in near for x, y in zip(a, b) if x or y}
                    if len({x for x, _ in pairs}) == len(pairs):
                        found = True
                        exact |= all(x == y for x, y in pairs)
            if radius > max(shifts) - min(shifts):
                break
            radius = 2 * radius or 1
    whole = len({p for p, _, _, a, b in hits if a == b}) >= coverage * of
    return (exact or whole and not plain) if found or whole else None


@pytest.mark.parametrize("sent", [decontaminate.SENT_WINDOWS, 0])
def test_decontamination_brute_force(spark, sent):
    """sent = 0 takes the way of large benchmarks: a filter and a salted join."""
    rng = np.random.default_rng(5)
    pick = lambda x: x[rng.integers(len(x))]
    some = lambda: pick([lambda: pick("takes gives buys eats the of with and then every".split()), lambda: str(rng.integers(1, 4)), lambda: pick(["Anna", "Bob"]), lambda: pick(["kg", "km"])])()
    made = lambda n: " ".join(some() for _ in range(n))
    items = [(i, made(n)) for i, n in enumerate([3, 5, 8, 9, 12, 14, 20, 25] * 2)] + [(90, None), (91, ""), (92, "3 4 5"), (93, items_text := "Tom buys 3 kg of apples for 12 dollars and eats 3 of them"), (93, items_text), (94, items_text)]
    vary = lambda t: t.replace("3", "7").replace("Anna", "Clara")
    rows = []
    for n in range(60):
        parts = [pick([made(6), t := pick(items)[1] or "", vary(t), vary(t).replace("7", "9", 1), t[: len(t) // 2], t[len(t) // 4 :]]) for _ in range(3)]
        rows.append((n, pick([" ", ". ", "\n"]).join(parts)))
    rows += [(100, None), (101, ""), (5, rows[5][1]), (5, items_text), (None, items_text), (None, "x " + vary(items_text)), (102, "w " * 30_000 + items_text + " z" * 30_000)]
    want = Counter()
    for i, t in {(i, t) for i, t in rows}:
        for j, s in {(j, s) for j, s in items}:
            if (e := leaks(t, s)) is not None:
                want[i, j, e] = 1
    frame = spark.createDataFrame([(*r, "h", 1.0) for r in rows], "doc_id long, text string, h string, k double").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, mark string")
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.decontaminate(frame, bench, sent=sent).collect()}
    assert got == set(want) and len({e for *_, e in want}) == 2


def test_decontamination_without_literals(spark):
    items = [(1, "Compute 12 + 7 - 3 * 5"), (2, "Anna 3 4 Bob 5 6 Carl 7 8 Dora 9 10 Emil 11 12")]
    rows = [(1, f"Exercise: {items[0][1]}. Go on."), (2, "x " + items[1][1] + " y"), (3, "Compute 12 + 7 - 3 * 6"), (4, "Compute 12 * 7 - 3 + 5"), (5, items[1][1].replace("4", "44").replace("7", "77").replace("10", "99"))]
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): True, (2, 2): True}


def test_html():
    page = "<html><head><title>T</title></head><body class=has-sidebar><nav><a href=x>Home</a></nav><div class='ad'>Buy.</div><article><h1>A &amp; B</h1><p>First, a  para\ngraph.<br><p>Second <b>one</b>.<script>no()</script></article><div id=comments><p>Nice, very nice.</p></div><footer>&copy; F.</footer></body>"
    assert html_extract.main_text(page) == "A & B\n\nFirst, a para graph.\n\nSecond one."
    assert [html_extract.main_text(x) for x in ("", "<p>", "<!-- a", "<nav>x</nav>")] == [""] * 4


@pytest.mark.parametrize("tag", ["article", "div class=body-text"])
def test_html_keeps_the_whole_container(tag):
    long = "A sentence, of some length; with marks. " * 10
    page = f"<body><ul class=menu><li><a href=x>Home</a></ul><{tag}><p>{long}</p><table><tr><td>1</td><td>22</td></tr></table><p>{long}</p><ol><li><a href=y>A reference</a></li></ol></{tag.split()[0]}><footer>F.</footer></body>"
    assert html_extract.main_text(page) == "\n\n".join([long.strip(), "1", "22", long.strip(), "A reference"])


def test_html_keeps_the_title():
    page = "<body><div class=site-header>Site.</div><article><div class='entry-header'><h1>Title</h1></div><p>Text, and more text.</p></article></body>"
    assert html_extract.main_text(page) == "Title\n\nText, and more text."


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ("<ul><li>Eggs</li><li>Milk</li></ul>", ["Eggs", "Milk"]), ("<table><tr><td>1</td><td>2</td></tr></table>", ["1", "2"]), ("<h2><a href=#s>Section one</a></h2>", ["Section one"]), ("<ol><li><a href=x>Ref</a></li></ol>", ["Ref"]), ("<section id='search-for-meaning'><p>Short.</p></section>", ["Short."]),
        ("<p class='social-history'>Hist.</p>", ["Hist."]), ("<blockquote>Said so.</blockquote><pre>x = 1</pre>", ["Said so.", "x = 1"]), ("<div class='share-buttons'>Share this</div><div class=notice>Cookies.</div><aside>Side.</aside><form>q</form><nav>n</nav>", []), ("<div class='comments'><p>Well, well; indeed.</p></div>", []),
    ],
)
def test_html_inside_an_article(inside, want):
    long = ("A sentence, of some length; with marks. " * 8).strip()
    for opening in ("<article>", "<article class='post alert-story'>", "<article class=alert>", "<main>"):
        page = f"<body class=has-sidebar><nav>menu</nav><div class=sidebar><p>{long}</p></div>{opening}<h1>T</h1><p>{long}</p>{inside}</{opening[1:].split('>')[0].split()[0]}><footer>F.</footer></body>"
        assert html_extract.main_text(page) == "\n\n".join(["T", long, *want])


class Reader(HTMLParser):
    """Whole text of the article of a well-formed page, by blocks, without what is none: a second way."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.held = [], [], ""

    def flush(self):
        if text := " ".join(self.held.split()):
            self.blocks.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held += " "
        elif tag not in ("b", "a", "em"):
            self.flush()
            self.stack.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "em"):
            self.flush()
            self.stack.pop()

    def handle_data(self, data):
        tags = {t for t, _ in self.stack}
        if "article" in tags and not tags & {"nav", "aside", "footer", "form", "script", "style"} and not {c for _, c in self.stack} & {"comments", "advert"}:
            self.held += data


def test_html_generated_pages(spark):
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(rng.choice("one two, three; four. five six: Seven &amp; &eacute; &#8212; x".split(), n))

    def block(depth=0):
        kind = rng.choice(["p", "ul", "table", "blockquote", "h2", "div", "nav", "aside", "comments", "advert", "pre", "script"], p=[0.4, 0.1, 0.1, 0.05, 0.1, 0.05, 0.03, 0.03, 0.05, 0.03, 0.03, 0.03])
        text = words(int(rng.integers(1, 40)))
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(3)) + "</ul>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td>{i}</td>" for i in range(3)) + "</tr></table>"
        if kind in ("comments", "advert"):
            return f"<div class='{kind}'><p>{text}</p></div>"
        if kind == "div" and depth < 2:
            return "<div>" + "".join(block(depth + 1) for _ in range(3)) + "</div>"
        return f"<{kind}>{text}<br>more <b>bold</b></{kind}>" if kind != "script" else "<script>var t = 1;</script>"

    pages = [f"<html><body><nav>{words(5)}</nav><div class='sidebar'><p>{words(60)}</p></div><article><h1>{words(4)}</h1><p>{words(60)}.</p>{''.join(block() for _ in range(int(rng.integers(0, 9))))}</article><footer>{words(9)}</footer></body></html>" for _ in range(150)]
    rows = [(i, f"u{i}", p) for i, p in enumerate(pages)] + [(7, None, None), (7, "u", pages[3]), (7, "u", pages[3]), (None, "v", ""), (8, "long", "<article><p>" + "word, " * 60_000 + "</p></article>")]
    got = multiset(tuple(r) for r in html_extract.html_extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect())
    want = []
    for i, u, p in rows:
        reader = Reader()
        reader.feed(p or "")
        reader.flush()
        want.append((i, u, "\n\n".join(reader.blocks)))
    assert got == multiset(want)


def test_html_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.html_extract(rows).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body[1] if body else "")]
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))


_BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_pii(spark, docs, hard):
    more = [(100, "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 999.1.1.1 +1 (2) 3-4 5.6789 0000255.1.1.01"), (101, "1" * 2_000 + "." + "a" * 2_000 + "+" * 500), (102, "a@b.co 1.2.3.4 " * 600)]
    columns = ["doc_id", "text", F.lit("x").alias("email"), F.lit(1).alias("added")]
    frame = docs.select(*columns).union(hard.select(*columns)).union(spark.createDataFrame(more, "doc_id long, text string").select(*columns))
    texts = multiset((r.doc_id, *[tuple(m.span() for m in re.finditer(p, r.text or "") if passes(k, m[0])) for k, p in _BASE.items()]) for r in frame.collect())
    model = pii.fit(docs)
    assert len(model.models) == len(pii.GENERATORS)
    found = pii.find_pii(frame, model=model).collect()
    assert multiset((r.doc_id, *[tuple((x.start, x.end) for x in r[k]) for k in _BASE]) for r in found) == texts
    base = [[(x.start, x.end) for k in _BASE for x in r[k]] for r in found]
    assert not any(x.start < b and a < x.end for r, spans in zip(found, base) for x in r.added for a, b in spans)
    assert not any(x != y and x.start < y.end and y.start < x.end for r in found for x in r.added for y in r.added)
    # Planted examples that the model has not seen: of each kind, nine of ten are found, few others.
    for kind, (name, _) in enumerate(pii.GENERATORS):
        rows = pii.planted(docs.select("text"), kind, 1234, 3)
        out = pii.find_pii(rows.select(F.col("key").alias("doc_id"), "text"), model=model).join(rows.select(F.col("key").alias("doc_id"), "start", "end", "label").dropDuplicates(["doc_id"]), "doc_id")
        met = F.exists(F.concat(F.transform("added", lambda a: F.struct(a["start"], a["end"])), *[F.transform(k, lambda a: F.struct(a["start"], a["end"])) for k in _BASE]), lambda a: (a["start"] < F.col("end")) & (F.col("start") < a["end"]))
        rates = {r.label: r.hit for r in out.groupBy("label").agg(F.avg(met.cast("int")).alias("hit")).collect()}
        assert rates[1] >= 0.9 and rates[0] <= 0.1, (name, rates)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    turns = spark.read.parquet(f"{SF}/conversations.parquet").limit(0)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    frames = [substring_dedup.substring_dedup(none), language_id.identify(none), license_scan.license_scan(none), jaccard_join.jaccard_components(none), chat_format.format_chats(turns), packing.pack(none), exact_dedup.exact_dedup(none), decontaminate.decontaminate(none, bench), decontaminate.decontaminate(docs, bench.limit(0)), html_extract.html_extract(pages), pii.find_pii(none)]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_without_and_single(spark):
    rows = spark.createDataFrame([(i, "t") for i in range(100)] + [(None, "t"), (None, "u"), (1, "u"), (1, "u")], "doc_id long, text string")
    on = {"doc_id": F.col("doc_id"), "of": F.col("text")}
    gone = rows.where("doc_id % 3 = 0 or text = 'u' and doc_id is null").select("doc_id", F.col("text").alias("of"))
    left = common.without(rows, gone, on)
    want = Counter([(i, "t") for i in range(100) if i % 3] + [(None, "t"), (1, "u"), (1, "u")])
    assert Counter(map(tuple, left.collect())) == want
    one = common.single(left, spark.createDataFrame([(1, "u"), (None, "t")], "doc_id long, of string"), on)
    assert Counter(map(tuple, one.collect())) == want - Counter([(1, "u")])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert multiset(tuple(r[n] for n in names) for r in got.collect()) == multiset(want.fetchall())


def test_pipeline(spark, docs):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert kept < set(rows) and len({rows[i] for i in kept}) == len(kept)
    assert not [i for i in kept if any(b in rows[i] for b in bench)]
    parts = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs.where(F.col("doc_id").isin(*kept))).collect()}
    assert all(i == c for i, c in parts.items())


def test_pipeline_stages_tell_rows_apart(spark, tmp_path):
    """Repeated, clashing and absent ids; columns of any name; empty tables."""
    import corpus_pipeline as c

    near_text = " ".join(f"t{i}" for i in range(60))
    other = near_text.replace("t30", "z30")
    rows = [(5, "alpha beta"), (5, "gamma delta"), (9, "alpha beta"), (9, "alpha beta"), (None, "alpha beta"), (None, "no id here"), (None, "no id here"), (7, None), (7, ""), (3, near_text), (2, other), (2, "gamma"), (2, other)]
    frame = spark.createDataFrame([(i, t, "en", "h", 1.5) for i, t in rows], "doc_id long, text string, lang string, h string, _slot double")
    left = multiset(tuple(r)[:2] for r in c.copies(spark, frame, None).collect())
    sure = multiset([(5, "gamma delta"), (9, "alpha beta"), (None, "no id here"), (3, near_text), (2, other), (2, "gamma")])
    assert not sure - left and set(left - sure) <= {repr((7, None)), repr((7, ""))} and sum((left - sure).values()) == 1
    kept = multiset(tuple(r)[:2] for r in c.near_copies(spark, frame, None).collect())
    assert kept[repr((2, other))] == 1 and not kept[repr((3, near_text))] and kept[repr((2, "gamma"))] == 1 and kept[repr((7, None))] == kept[repr((7, ""))] == 1
    assert kept[repr((5, "alpha beta"))] == 1 and not kept[repr((9, "alpha beta"))] and kept[repr((None, "no id here"))] == 1
    spark.createDataFrame([(1, "gamma delta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = c.leaks(spark, frame, str(tmp_path))
    assert out.columns == frame.columns and multiset(tuple(r)[:2] for r in out.collect()) == multiset(r for r in rows if r[1] != "gamma delta")
    none = frame.limit(0)
    assert [f.count() for f in (c.language(spark, none, None), c.copies(spark, none, None), c.near_copies(spark, none, None), c.leaks(spark, none, str(tmp_path)), c.packed(spark, none, None))] == [0] * 5


def test_encoder_equals_the_whole_tokenizer():
    """Texts of hard characters: the fast way gives the ids that tokenizers gives."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    pool = list("aZ éß0 '’.,!?\t\n\r\u00a0\u2003\u3000\u200b𝒳中ا🙂_-<|>") + ["  ", "\n\n", "'s", "'ll", " 12", "<|endoftext|>"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["".join(rng.choice(pool, int(rng.integers(0, 40)))) for _ in range(4000)]
    for t, ids in zip(texts, packing.encode(texts, packing.tokenizer_path(), packing.tokenizer_path("byte_bpe_50k.tiktoken"))):
        assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 0], repr(t)


def test_pooled_positions_by_hand():
    """Pooling over batches of segments equals one text at a time, position by position."""
    network = language_id.Network(["a", "b", "c"])
    texts = [b"", b"x", b"y" * 127, b"z" * 128, bytes(range(256)) * 2, b"end"]
    got = language_id.pooled(network, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for row, t in zip(got, texts):
        parts = [np.frombuffer(t[i : i + language_id.SEGMENT], np.uint8)[:, None] for i in range(0, len(t), language_id.SEGMENT)]
        total = sum((network.probabilities(p, None).sum((1, 2)) for p in parts), np.zeros(3))
        assert np.allclose(row, total / max(1, len(t)), atol=1e-4)
