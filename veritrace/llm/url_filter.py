"""URL filters: rules on hosts and paths, and logistic regression on hashed character n-grams.

The model is learned from a small table of labelled URLs. Its features are the character n-grams of the
host and of the path, each with the bounds of its part, hashed into one table of weights; a URL's score is
the logistic function of its grams' weights. Rules decide where one fits, the score elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, buffers, in_arrow, mix

#: Bytes of a gram, and hashed features.
SIZES, WIDTH = (3, 4, 5), 1 << 18
#: Labelled URLs that are learned from, at most; the weight of the penalty, and the steps.
MOST_LABELLED, PENALTY, STEPS, RATE = 20_000, 0.3, 300, 0.05
#: A score from here on blocks.
BLOCK_FROM = 0.5

#: (verdict, host, path): a rule fits its host and all hosts below it.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Words of which the labelled URLs are made: hosts of pages nobody wants to learn from, and of others.
UNWANTED = "casino poker slots betting bets jackpot lottery roulette bingo pills pharmacy viagra cialis pharma steroids diet adult sex xxx porn escort webcam dating loans payday credit spam scam phishing malware ads adserver tracker tracking clicks popup banner affiliate torrent warez crack keygen serial replica fake cheap free win prize giveaway bonus seo backlinks linkfarm farm".split()
WANTED = "news journal library museum school college university science physics biology history archive weather garden kitchen recipes travel maps city council health hospital clinic law court music theatre cinema books review press daily weekly forum community wiki docs developer code software data research institute energy water forest river mountain coast bank market trade shop sports football chess gallery studio radio parents farmers freedom windows winter essex address discount cheapside".split()


_TAILS = "online world zone shop group today central point".split()
_ONSETS = "b c d f g h k l m n p r s t v w th sh ch st tr br gr pl".split()
_VOWELS = "a e i o u ea ou ie".split()
_CODAS = ["", "n", "r", "s", "t", "l", "nd", "ng", "th", "ble", "tion", "er", "ly", "ck"]
_LEADS, _ENDS = ["", "www.", "m.", "blog."], ["com", "net", "org", "info", "example.com", "example.net", "example.org"]
#: Paths of either kind, with a number put in, and those that only unwanted pages have.
_PATHS = ["/", "/en/{}", "/de/{}.html", "/fr/{}?page=2", "/about", "/es/{}/", "/article/{}/title-of-it", "/index.html", "/en/{}#top", "/category/item?id={}"]
_BAD_PATHS = ["/win-free-bonus", "/click?aff={}", "/buy-cheap-pills", "/promo/jackpot"]


def _path(i: int, unwanted: bool) -> str:
    paths = _BAD_PATHS if unwanted and i % 4 == 0 else _PATHS
    return paths[i * 3 % len(paths)].format(i * 7919 % 100_000)


def labelled(words: list[str], unwanted: bool) -> list[tuple[str, int]]:
    """URLs made of words: each alone, with common tails, and with others of them, with and without a dash."""
    out = []
    for i, word in enumerate(words):
        other, third = words[(i * 7 + 3) % len(words)], words[(i * 5 + 1) % len(words)]
        tail, more = _TAILS[i % 8], _TAILS[(i + 3) % 8]
        for j, name in enumerate((word, f"{word}-{other}", other + word, f"{word}-{tail}", more + word, f"{third}-{word}", f"{more}-{word}", word + tail)[: 8 if unwanted else 5]):
            out.append((f"http{'s' * (i % 2)}://{_LEADS[(i + j) % 4]}{name}.{_ENDS[(i * 3 + j) % 7]}{_path(8 * i + j, unwanted)}", int(unwanted)))
    return out


def nameless(n: int) -> list[tuple[str, int]]:
    """URLs of names without a meaning, which are no ground to block."""
    part = lambda i, k: _ONSETS[(i * (5 + k) + k) % len(_ONSETS)] + _VOWELS[(i * (3 + k) + i // 7) % 8] + _CODAS[(i * (k + 1) + i // 5) % 14]
    return [(f"https://{_LEADS[i % 4]}{''.join(part(i, k) for k in range(2 + i % 2))}.{_ENDS[i % 7]}{_path(i, False)}", 0) for i in range(n)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default table (url, unwanted): about 1,100 rows, made of the words above by rule."""
    return spark.createDataFrame(labelled(UNWANTED, True) + labelled(WANTED, False) + nameless(400), "url string, unwanted int")


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The rule that fits: struct<rule, verdict>, null if none does. Longest wins, then the one with the
    longer host, then block. rules are a parameter, a few hundred at most: an expression holds them."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        out = F.when(fits, F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


#: Which digit it is says nothing about a page: numbers are compared by their length.
_DIGITS_ALIKE = np.arange(256, dtype=np.uint8)
_DIGITS_ALIKE[0x30:0x3A] = 0x30


def grams(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of the texts, with a bound at both ends and digits alike: (text, feature) of each."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    body = np.full(len(data) + 2 * n, 1, np.uint8)  # a text between two bounds
    edge = offsets + 2 * np.arange(n + 1)
    inner = np.repeat(edge[:-1] + 1 - offsets[:-1], size) + np.arange(len(data))
    body[inner] = _DIGITS_ALIKE[data]
    text = np.repeat(np.arange(n), np.diff(edge))
    left = edge[1:][text] - np.arange(len(body))  # bytes from here to the text's end
    wide = np.concatenate([body, np.zeros(8, np.uint8)]).astype(U64)
    out = []
    for k in SIZES:
        at = np.flatnonzero((left >= k) & (size[text] > 0))
        code = np.full(len(at), U64(seed * 16 + k))
        for j in range(k):
            code = (code << U64(8)) | wide[at + j]
        out.append((text[at], (mix(code) % U64(WIDTH)).astype(np.int64)))
    return np.concatenate([t for t, _ in out]), np.concatenate([f for _, f in out])


def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a, b = grams(*buffers(host), 1), grams(*buffers(path), 2)
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


class Logistic:
    """Weights of hashed grams. A gram that no labelled URL has weighs nothing."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        text, feature = features(host, path)
        total = np.bincount(text, self.weights[feature], len(host))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def train(host: pa.Array, path: pa.Array, label: np.ndarray) -> Logistic:
    """Minimises the mean logistic loss with a squared penalty, by Adam over all rows."""
    text, feature = features(host, path)
    used, at = np.unique(feature, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(text, w[at], len(label)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(label)
        g = np.append(np.bincount(at, off[text], len(used)) + PENALTY * w / len(label), off.sum())
        first += 0.1 * (g - first)
        second += 0.01 * (g * g - second)
        move = RATE * (1 - (step - 1) / STEPS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    weights = np.zeros(WIDTH)
    weights[used] = w
    return Logistic(weights, bias)


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "unwanted", most: int = MOST_LABELLED) -> Logistic:
    """Learns from labelled URLs (label 1: unwanted), `most` different ones at most, chosen by a hash of
    the URL. Rows without a URL or a label are left out; a table without a row gives a model that blocks nothing."""
    rows = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("label")).where("url is not null and label is not null")
    rows = rows.groupBy("url").agg(F.max("label").alias("label")).select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label", F.xxhash64("url").alias("h"), "url")
    got = rows.orderBy("h", "url").limit(most).select("host", "path", "label").toArrow()
    if not got.num_rows:
        return Logistic(np.zeros(WIDTH), -30.0)
    return train(got.column("host").combine_chunks(), got.column("path").combine_chunks(), got.column("label").to_numpy().astype(float))


def judge_urls(pages: DataFrame, model: Logistic | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", block_from: float = BLOCK_FROM) -> DataFrame:
    """One row per row of pages: (id, host, path, rule, verdict, score). rule is the longest that fits, as
    host and path; verdict is the rule's, else block for a score from block_from on and allow below.

    A null URL or one without `://` has an empty host and path, fits no rule and has no gram: its score is 0
    and it is allowed. Whole URLs are read, however long; grams are of bytes in UTF-8. Equal URLs get equal
    answers; repeated rows and rows without an id are judged row by row; an empty table gives no rows; further
    columns, whatever their names, are ignored and not read. Rows never meet, so no host can be hot.
    Without a model, one is learned from labelled_urls.
    """
    model = model or fit(labelled_urls(pages.sparkSession))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "own.rule", "own.verdict")

    def score(batches):
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            s = model.scores(host, path)
            s[np.diff(buffers(host)[1]) + np.diff(buffers(path)[1]) == 0] = 0.0
            yield batch.append_column("score", pa.array(s))

    out = rows.transform(in_arrow, score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    judged = F.coalesce("verdict", F.when(F.col("score") >= block_from, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", judged.alias("verdict"), "score")
