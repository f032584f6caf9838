"""Secret scans with a random forest that removes false positives (operator 7).

Patterns find candidates, and take in more than they should: key-like runs with a digit or a known
beginning, whatever is assigned to a secret's name, bearer tokens, passwords in URLs, whole web
tokens and private key blocks. A random forest, trained in numpy from labelled findings, tells
secrets from what only looks like one: checksums, commit and order numbers, card numbers, UUIDs,
paths, identifiers, plain words. It looks at the candidate's length, its transitions between
characters, how much of it dictionary words cover (those that are frequent in the documents, and some
that configuration and code use), whether it is part of a path or address, and the neighbouring words.

Candidates don't overlap: of nested or overlapping ones, that of the pattern which stands first in
PATTERNS holds, then the one that begins first. Adjacent ones are each a candidate.

Findings to train from are a parameter. Those used where no own ones are at hand come from a generator,
which knows the kinds of secrets and of look-alikes below.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._common import slices, written

#: Characters before and after a candidate that its features see.
CONTEXT = 48
MASK = "[SECRET]"
#: Candidates whose features are in memory at a time.
SCORED = 4096
THRESHOLD = 0.5
#: Words of the documents that the dictionary takes in, at most: the most frequent ones of so many letters.
MOST_WORDS, WORD_LETTERS = 5000, (4, 12)
#: Labelled findings that the forest is fitted on, at most; those of the smallest hashes.
MAX_FINDINGS = 20_000

# Words and key prefixes that the features count.
SECRET_WORDS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "api", "auth", "bearer", "credential", "credentials", "access", "private", "login"]
BENIGN_WORDS = ["commit", "sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "revision", "uuid", "guid", "id", "order", "invoice", "ticket", "phone", "card", "isbn", "etag", "version", "build", "trace", "request", "session", "file", "blob", "object", "serial", "tracking", "reference"]
SECRET_NAMES = ["passw", "passphrase", "pwd", "secret", "token", "key", "auth", "credential", "private", "cookie"]
KEY_PREFIXES = ["AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "SG_", "npm_", "hf_"]
DICTIONARY = ["the", "and", "for", "with", "this", "that", "from", "your", "here", "user", "name", "test", "example", "sample", "demo", "data", "file", "path", "image", "index", "page", "item", "list", "main", "home", "config", "server", "client", "version", "release", "build", "model", "table", "column", "value", "number", "string", "array", "object", "class", "method", "function", "return", "update", "create", "delete", "select", "order", "report", "project", "service", "system", "change", "insert", "place", "holder", "placeholder", "dummy", "default", "local", "host", "http", "https", "www", "html", "json", "text", "time", "date", "year", "month", "week", "photo", "video", "music", "copy", "draft", "final", "backup", "archive", "log", "temp", "key", "token", "secret", "password"]

_RUN = re.compile(rf"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9]|{'|'.join(map(re.escape, KEY_PREFIXES))})[A-Za-z0-9_+/\-]{{12,}}+={{0,2}}")
_NAME = re.compile("|".join(SECRET_NAMES), re.I)
_BEGIN, _END = (re.compile(rf"-----{x} [A-Z ]{{0,32}}PRIVATE KEY-----") for x in ("BEGIN", "END"))
_NOT_IN_BLOCK = re.compile(r"[^A-Za-z0-9+/=\s:,\-]")
_WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]++){1,2}+")
_URL = re.compile(r"://[^\s/:@]*+:(?P<v>[^\s/@]{3,}+)(?=@)")
_BEARER = re.compile(r"(?i)\bbearer[ \t]{1,3}(?=(?P<v>[A-Za-z0-9._~+/\-]{8,}+={0,2}))")
_ASSIGNED = re.compile(r"(?<![\w.\-])(?P<name>[\w.\-]++)[\"'\]]{0,2}[ \t]{0,3}(?:=>|:=|==|[=:])[ \t]{0,3}(?P<quote>[\"'`]?)")
#: What ends an assigned value, without quotes and in them; and what it does not end with.
_VALUE_ENDS, _QUOTED_ENDS = re.compile(r"[\s\"'`,;&|<>(){}\[\]]"), re.compile(r"[\s\"'`]")
_NO_LAST, LEAST_VALUE = ".!?:", 4
_NEIGHBOUR = re.compile(r"[a-z0-9]+")
_UUID = re.compile(r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
_HEX = re.compile(r"[0-9a-fA-F]+$")
_SECRET, _BENIGN = set(SECRET_WORDS), set(BENIGN_WORDS)
_SYMBOLS = set("!#$%&*?@^~|.,;:")
_COMMON_PAIRS = {a + b for w in DICTIONARY for a, b in zip(w, w[1:], strict=False)}
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4096)
def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def covered(text: str, words: frozenset[str]) -> int:
    """Letters of a text in lower case that words cover: from the left, the longest that begins there."""
    longest, total = WORD_LETTERS[1], 0
    for run in _LETTERS.finditer(text):
        at, end = run.span()
        while end - at > 2:
            for n in range(min(longest, end - at), 2, -1):
                if text[at : at + n] in words:
                    total += n
                    at += n
                    break
            else:
                at += 1
    return total


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(doubled)) % 10 == 0


def features(before: str, candidate: str, after: str, words: frozenset[str] = frozenset(DICTIONARY)) -> list[float]:
    """Of a whole candidate, whatever its length, and of what stands beside it."""
    body = candidate.rstrip("=") or "="
    n, lower = len(body), body.lower()
    counts, moves = Counter(body), [[0] * 4 for _ in range(4)]
    of = [0.0] * 4
    for c, k in counts.items():
        of[_kind(c)] += k / n
    for (a, b), k in Counter(zip(body, body[1:], strict=False)).items():
        moves[_kind(a)][_kind(b)] += k / max(1, n - 1)
    letters = [(a + b, k) for (a, b), k in Counter(zip(lower, lower[1:], strict=False)).items() if a.isalpha() and b.isalpha()]
    near_before, near_after = _NEIGHBOUR.findall(before.lower())[-3:], _NEIGHBOUR.findall(after.lower())[:2]
    left, right = before.rstrip(" \"'`")[-1:], after[:1]
    near = set(near_before + near_after)
    return [
        # length
        len(candidate),
        candidate.count("="),
        float(n in (32, 40, 64)),
        # characters and transitions between them
        *of,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        1 - sum(moves[k][k] for k in range(4)),
        moves[0][1] + moves[1][0],
        moves[0][2] + moves[2][0],
        moves[1][2] + moves[2][1],
        sum(k for x, k in letters if x in _COMMON_PAIRS) / max(1, sum(k for _, k in letters)),
        float(bool(_HEX.match(body))),
        float(bool(_UUID.match(body))),
        float(body.isdigit() and _luhn(body)),
        float(any(body.startswith(x) for x in KEY_PREFIXES)),
        float(candidate.startswith("-----BEGIN")),
        sum(c in _SYMBOLS for c in counts),
        # dictionary coverage
        covered(lower, words) / n,
        # path
        body.count("/") + body.count("-") + body.count("_"),
        body.count("."),
        float("://" in before.rsplit(None, 1)[-1] if before.strip() else 0),
        float(body[:1] in "/.$%{~" or body[-1:] == "/"),
        float(left in ("/", ".", "@", "#")),
        float(right in ("/", ".", "@")),
        # neighbouring words
        float(bool(near & _SECRET)),
        float(bool(set(near_before[-1:]) & _SECRET)),
        float(bool(near & _BENIGN)),
        float(bool(set(near_before[-1:]) & _BENIGN)),
        float(left in ("=", ":", ">")),
        float(before[-1:] in ("'", '"', "`")),
    ]


class RandomForest:
    """Binary classification trees on bootstrap samples; each split looks at some features only.

    A tree is arrays over its nodes: the feature (-1 for a leaf), the threshold, the children and
    the share of positives."""

    #: The dictionary that its features were counted with.
    words: frozenset[str] = frozenset(DICTIONARY)

    def __init__(self, trees: int = 48, depth: int = 10, least: int = 3, seed: int = 5):
        self.size, self.depth, self.least, self.seed = trees, depth, least, seed
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        self.trees = []
        for _ in range(self.size):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows].astype(float), self.depth, rng, nodes)
            t = np.array(nodes)
            self.trees.append((t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4]))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y.mean()])
        if depth and len(y) >= 2 * self.least and 0 < y.sum() < len(y):
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y) + 1)
                cut = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= self.least) & (len(y) - n[:-1] >= self.least))
                if len(cut):
                    a, na = ones[cut] / n[cut], n[cut]
                    b, nb = (ones[-1] - ones[cut]) / (len(y) - na), len(y) - na
                    gain = y.mean() * (1 - y.mean()) - (na * a * (1 - a) + nb * b * (1 - b)) / len(y)
                    if gain.max() > best[0]:
                        k = cut[gain.argmax()]
                        best = (gain.max(), f, mid if (mid := (v[k] + v[k + 1]) / 2) < v[k + 1] else v[k])
            if best[1] >= 0:
                low = x[:, best[1]] <= best[2]
                nodes[me][:2] = best[1:]
                nodes[me][2] = self._grow(x[low], y[low], depth - 1, rng, nodes)
                nodes[me][3] = self._grow(x[~low], y[~low], depth - 1, rng, nodes)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees."""
        total = np.zeros(len(x))
        for feature, threshold, low, high, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                go_low = x[np.arange(len(x)), feature[at]] <= threshold[at]
                at = np.where(inner, np.where(go_low, low[at], high[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks: a first line, the next last line, and nothing else between but what keys hold.
    Positions looked for only move forward."""
    ends, end, foreign, done = _END.finditer(text), None, None, 0
    for begin in _BEGIN.finditer(text):
        if begin.start() < done:
            continue
        while end is None or end.start() < begin.end():
            end = next(ends, None)
            if end is None:
                return
        if foreign is None or foreign < begin.end():
            found = _NOT_IN_BLOCK.search(text, begin.end())
            foreign = found.start() if found else len(text)
        if end.start() <= foreign:
            done = end.end()
            yield begin.start(), done


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values assigned to secrets' names. Where values nest (name=name=value), they end at the same place,
    which is looked for once."""
    known = {_VALUE_ENDS: (-1, -1), _QUOTED_ENDS: (-1, -1)}  # the last end found, and that without what none ends with
    for m in _ASSIGNED.finditer(text):
        if not _NAME.search(m["name"]):
            continue
        start, ends = m.end(), _QUOTED_ENDS if m["quote"] else _VALUE_ENDS
        if start > known[ends][0]:
            found = ends.search(text, start)
            end = trimmed = found.start() if found else len(text)
            while trimmed > start and text[trimmed - 1] in _NO_LAST:
                trimmed -= 1
            known[ends] = end, trimmed
        if known[ends][1] - start >= LEAST_VALUE:
            yield start, known[ends][1]


#: What finds the candidates, the most telling first.
PATTERNS = [
    _blocks,
    lambda text: (m.span() for m in _WEB_TOKEN.finditer(text)),
    lambda text: (m.span("v") for m in _URL.finditer(text)),
    lambda text: (m.span("v") for m in _BEARER.finditer(text)),
    _assigned,
    lambda text: (m.span() for m in _RUN.finditer(text)),
]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each candidate of a whole text, in code points and in order."""
    taken: list[tuple[int, int]] = []
    for pattern in PATTERNS:
        more, at = [], 0
        for a, z in pattern(text):
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if (at < len(taken) and taken[at][0] < z) or (more and more[-1][1] > a):
                continue
            more.append((a, z))
        taken = sorted(taken + more)
    return taken


class _Examples:
    """A source of labelled findings. SECRET and BENIGN: kinds, as methods that return what stands
    before a candidate and the candidate."""

    SECRET = ["hexadecimal", "letters_and_digits", "base64", "cloud_key", "prefixed", "web_token", "password", "worded_password", "letters_only", "url_password", "key_block", "bearer"]
    BENIGN = ["checksum", "bare_hex", "uuid", "number", "path", "slug", "placeholder", "camel_case", "date", "word_and_digits", "sum", "assigned_word", "reference", "assigned_number"]

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.hexa, self.alnum = "0123456789abcdef", string.ascii_letters + string.digits

    def pick(self, chars: str, a: int, b: int | None = None) -> str:
        return "".join(self.rng.choices(chars, k=self.rng.randint(a, b or a)))

    def prose(self) -> str:
        return " ".join(self.pick(string.ascii_lowercase, 2, 8) for _ in range(self.rng.randint(1, 5)))

    def named(self) -> str:
        names = ["password", "passwd", "pwd", "secret", "token", "api_key", "auth_token", "access_key", "private_key", "db_password", "API_KEY", "SECRET_KEY"]
        return self.rng.choice(["", self.prose() + " ", "my_"]) + self.rng.choice(names) + self.rng.choice(["=", " = ", ": ", '="', ' = "', "='", ' => "', '": "'])

    def or_prose(self) -> str:
        return self.rng.choice([self.named(), self.prose() + " "])

    def word(self) -> str:
        return self.rng.choice(DICTIONARY)

    def hexadecimal(self):
        return self.named(), self.pick(self.hexa, 16, 64)

    def letters_and_digits(self):
        return self.named(), self.pick(self.alnum, 14, 48)

    def base64(self):
        return self.named(), self.pick(self.alnum + "+/", 24, 64) + "=" * self.rng.randint(0, 2)

    def cloud_key(self):
        return self.prose() + " ", self.rng.choice(["AKIA", "ASIA"]) + self.pick(string.ascii_uppercase + string.digits, 16)

    def prefixed(self):
        return self.or_prose(), self.rng.choice(["ghp_", "gho_", "npm_", "hf_", "sk-", "sk_live_", "xoxb-", "glpat-"]) + self.pick(self.alnum, 20, 40)

    def web_token(self):
        return self.or_prose(), ".".join(["eyJ" + self.pick(self.alnum, 15, 60), *(self.pick(self.alnum + "_-", 20, 90) for _ in range(2))])

    def password(self):
        return self.named(), self.pick(self.alnum + "!#$%&*?@^", 6, 16) + self.pick(self.alnum, 1)

    def worded_password(self):
        words = [w.title() if self.rng.random() < 0.3 else w for w in (self.pick(string.ascii_lowercase, 3, 7), self.word())]
        self.rng.shuffle(words)
        return self.named(), words[0] + self.pick(string.digits, 1, 3) + words[1] + self.pick(string.digits + "!#$", 1, 3) + self.pick(string.digits, 1)

    def letters_only(self):
        return self.named(), self.pick(string.ascii_letters, 14, 40)

    def url_password(self):
        scheme = self.rng.choice(["postgres", "mysql", "https", "redis", "amqp", "mongodb", "ftp"])
        return f"{scheme}://{self.rng.choice(['', 'admin', 'root', self.word()])}:", self.pick(self.alnum + "!$%_-", 6, 20)

    def key_block(self):
        kind = self.rng.choice(["", "RSA ", "EC ", "OPENSSH "])
        body = "\n".join(self.pick(self.alnum + "+/", 64) for _ in range(self.rng.randint(2, 12)))
        return self.prose() + "\n", f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"

    def bearer(self):
        return self.rng.choice(["Authorization: ", self.prose() + " "]) + "Bearer ", self.pick(self.alnum + "._-", 16, 60) + self.pick(self.alnum, 1)

    def checksum(self):
        return self.prose() + " " + self.rng.choice(BENIGN_WORDS) + self.rng.choice([" ", ": ", "=", " = "]), self.pick(self.hexa, self.rng.choice([32, 40, 64]))

    def bare_hex(self):
        return self.prose() + " ", self.pick(self.hexa, self.rng.choice([32, 40, 64]))

    def uuid(self):
        return self.rng.choice([self.prose() + " ", "id=", "uuid: ", "key "]), str(uuid.UUID(int=self.rng.getrandbits(128), version=4))

    def number(self):
        return self.rng.choice([self.prose() + " ", "card ", "| ", "no. ", "order "]), self.pick(string.digits, 12, 19)

    def path(self):
        return f"https://{self.pick(string.ascii_lowercase, 2, 8)}.example.", "com/" + "/".join(self.word() + self.pick(string.digits, 0, 4) for _ in range(3)) + self.pick(string.digits, 1, 3)

    def slug(self):
        return self.prose() + " ", "-".join(self.word() for _ in range(self.rng.randint(2, 4))) + "-" + self.pick(string.digits, 1, 6)

    def placeholder(self):
        return self.or_prose(), self.rng.choice(["your_", "example_", "my_", "test_", "dummy_", "your-", "insert-"]) + self.rng.choice(["password", "token", "secret_key", "api_key", "key"]) + self.rng.choice(["_here1", "_123", "_placeholder0", "", "_here", "-here"])

    def camel_case(self):
        return self.prose() + " ", self.word() + self.word().title() + self.word().title() + self.pick(string.digits, 1, 3)

    def date(self):
        r = self.rng
        return self.prose() + " ", f"20{self.pick(string.digits, 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}"

    def word_and_digits(self):
        return self.prose() + " ", self.pick(string.ascii_lowercase, 9, 16) + self.pick(string.digits, 1, 4)

    def sum(self):
        return self.prose() + " ", "+".join(self.pick(string.digits, 3, 5) for _ in range(4))

    def assigned_word(self):
        return self.named(), self.rng.choice([self.word() + self.rng.choice(["", self.word(), "ed", "ing", "s"]), "null", "None", "true", "false", "required", "string", "optional", "nothing", "undefined", self.pick(string.ascii_lowercase, 4, 9)])

    def reference(self):
        forms = ["os.environ", "process.env." + self.word().upper(), "self." + self.word(), self.word() + "." + self.word(), "$" + self.word().upper(), "/" + self.word() + "/" + self.word(), self.word() + "_" + self.word(), "get" + self.word().title() + self.word().title()]
        return self.named(), self.rng.choice(forms)

    def assigned_number(self):
        return self.named(), self.pick(string.digits, 4, 6)

    def findings(self, n: int, kinds: list[str]) -> list[tuple[str, str, str, int]]:
        """So many findings of these kinds, those of either label as often if both are among them."""
        of = [ks for ks in ([k for k in kinds if k in self.BENIGN], [k for k in kinds if k in self.SECRET]) if ks]
        found, tried = [], 0
        while len(found) < n:
            tried += 1
            kind = self.rng.choice(of[tried % len(of)])
            before, candidate = getattr(self, kind)()
            after = "@" + self.word() + ".example.com" if kind == "url_password" else self.rng.choice(['"', "'", "", ",", "\n"]) + " " + self.prose()
            if (len(before), len(before) + len(candidate)) in candidates(before + candidate + after):
                found.append((before[-CONTEXT:], candidate, after[:CONTEXT], int(kind in self.SECRET)))
        return found


def example_findings(n: int = 6000, seed: int = 3, kinds: list[str] | None = None, without: tuple[str, ...] = ()) -> list[tuple[str, str, str, int]]:
    """Labelled findings to train from where no own ones are at hand: (before, candidate, after, label).

    Half are keys and passwords as configuration, code and prose hold them, half what they are
    mistaken for; of these kinds (all, if None) but those left out."""
    kinds = kinds or _Examples.SECRET + _Examples.BENIGN
    return _Examples(seed).findings(n, [k for k in kinds if k not in without])


def frequent_words(docs: DataFrame, text_col: str = "text") -> frozenset[str]:
    """The most frequent words of all documents, in lower case, and those of DICTIONARY: what covers a
    candidate. Words are counted where they are before anything is shuffled; the driver gets how many
    there are by eighths of powers of two of their counts, and then the words above the step at which
    they would be more than MOST_WORDS."""
    low, high = WORD_LETTERS
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("w")).filter(F.length("w").between(low, high))
    counts = written(words.groupBy("w").agg(F.count("*").alias("n")), "words")
    total, least = 0, None
    for _, rows, n in sorted(counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*"), F.min("n")).collect(), reverse=True):
        total += rows
        if total > MOST_WORDS:
            break
        least = n
    frequent = [] if least is None else counts.filter(F.col("n") >= least).select("w").collect()
    return frozenset(DICTIONARY) | {r.w for r in frequent}


def fit_forest(findings: list[tuple[str, str, str, int]] | DataFrame | None = None, words: frozenset[str] = frozenset(DICTIONARY)) -> RandomForest:
    """A forest from labelled findings (before, candidate, after, label: 1 for a secret); the examples
    if None. words: the dictionary that covers candidates. Of a table, rows with nulls are left out, and at most MAX_FINDINGS are taken, by hash. Without findings
    nothing is a secret."""
    if isinstance(findings, DataFrame):
        names = ["before", "candidate", "after", "label"]
        rows = findings.select(*names).dropna().filter("candidate <> ''")
        findings = [(r.before, r.candidate, r.after, int(r.label)) for r in rows.orderBy(F.xxhash64(*names), *names).limit(MAX_FINDINGS).collect()]
    findings = example_findings() if findings is None else findings
    if not findings:
        return RandomForest(trees=0)
    forest = RandomForest().fit(np.array([features(*f[:3], words) for f in findings], float), np.array([f[3] for f in findings]))
    forest.words = words
    return forest


def scan(texts: list[str], forest: RandomForest) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of each candidate of each whole text; in code points."""
    spans = [candidates(t) for t in texts]
    wanted = ((t, a, b) for t, found in zip(texts, spans, strict=True) for a, b in found)
    scores: list[float] = []
    while some := list(islice(wanted, SCORED)):
        rows = [features(t[max(0, a - CONTEXT) : a], t[a:b], t[b : b + CONTEXT], forest.words) for t, a, b in some]
        scores += forest.score(np.array(rows, float)).tolist()
    of = iter(scores)
    return [[(a, b, next(of)) for a, b in found] for found in spans]


def find_secrets(docs: DataFrame, forest: RandomForest | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, secret_sha256, score, is_secret) for each candidate of each row.

    start is a 0-based code point; the candidate itself isn't returned, but its digest is. Texts
    without candidates and null texts have no rows. Null ids stay; a repeated row's candidates are
    repeated. A score at the threshold counts as secret. Very long texts take time in proportion to
    their length. Other columns are not read; an empty table gives an empty one.
    """
    key, shared = docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(forest or fit_forest(words=frequent_words(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [(i, a, z - a, hashlib.sha256(texts[i][a:z].encode()).hexdigest(), s, s >= threshold) for i, spans in enumerate(scan(texts, shared.value)) for a, z, s in spans]
            row, *columns = zip(*found, strict=True) if found else ([],) * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "start", "length", "secret_sha256", "score", "is_secret"])

    schema = f"`{id_col}` {key}, start bigint, length bigint, secret_sha256 string, score double, is_secret boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def mask_secrets(docs: DataFrame, forest: RandomForest | None = None, threshold: float = THRESHOLD, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows with secrets in the text replaced by a mask, and the length column, if the table
    has it, set to the new length in code points where the text changed. Null text stays null, and a
    repeated row is masked as often as it occurs. A score at the threshold counts as secret. An empty
    table stays empty; other columns stay as they are."""
    at, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(forest or fit_forest(words=frequent_words(docs, text_col)))
    size_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            sizes = b.column(size_at).to_pylist() if size_at is not None else None
            for i, spans in enumerate(scan([t or "" for t in texts], shared.value)):
                cuts = [(a, z) for a, z, s in spans if s >= threshold]
                if cuts:
                    edges = [0, *(x for cut in cuts for x in cut), len(texts[i])]
                    texts[i] = MASK.join(texts[i][a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                if cuts and sizes is not None:
                    sizes[i] = len(texts[i])
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.column(at).type)
            if sizes is not None:
                columns[size_at] = pa.array(sizes, b.column(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
