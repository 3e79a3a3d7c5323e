"""Secret scanning with a random forest that removes false findings.

Candidates come from expressions for assignments, well-known key shapes and
long mixed runs, however long. A forest judges each by its length, character classes and
transitions, dictionary coverage, path and neighbouring words. It is trained on
labelled findings; ``labelled_findings`` makes a seeded set of them from shapes
of real and false findings, and ``train`` takes any other.

Null and empty texts have no findings. A text is scanned whole; the same secret
found twice is two findings. Overlapping candidates become the longest one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ASSIGNED = re.compile(r"""(?i)\b(?:api[_-]?key|access[_-]?key|auth|token|secret|passw(?:or)?d|pwd|credential|bearer)[\w-]{0,20}["']?[ \t]{0,4}(?:[:=]|:=|=>)?[ \t]{0,4}["']?([A-Za-z0-9+/_.~!@#$%^&*-]{8,}={0,2})""")
SHAPES = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----")
RUNS = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: What a text must hold to have a candidate at all: a run, a short shape's beginning, or a keyword and eight letters as ASSIGNED takes them. It runs in the JVM before rows go to Python.
SIEVE = r"""[A-Za-z0-9+/_-]{20}|xox[abprs]-|eyJ|-----BEGIN|(?iu:key|auth|token|secret|passw|pwd|credential|bearer)\S{0,20}["']?[ \t]{0,4}[:=>]{0,2}[ \t]{0,4}["']?[^\s"']{8}"""
SECRET_WORDS = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "api")
OTHER_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "uuid", "guid", "revision", "digest", "etag", "example", "placeholder", "sample", "build", "order", "invoice", "isbn", "version")
DICTIONARY = ("example", "test", "dummy", "your", "here", "change", "me", "placeholder", "sample", "user", "name", "service", "account", "config", "default", "value", "string", "number", "system", "manager", "factory", "controller", "handler", "request", "response", "the", "and", "ing", "tion", "ment", "ver", "for", "with", "that", "this", "from", "data", "file", "path", "index", "home", "local", "lib", "src", "main", "password", "secret", "token", "key", "xxxx", "1234", "abcd", "ung", "keit", "lich", "que", "eau", "elle", "cion", "mente", "ado")
#: Kinds of findings; of equal spans the first kind is told, as a known shape says more than an assignment, and that more than a run.
KINDS = ("shape", "assigned", "run")
FEATURES = ("length", "digits", "lower", "upper", "other", "entropy", "transitions", "vowels", "repeats", "coverage", "path", "secret_word", "other_word", "assigned", "shape", "hex", "one_class", "sequence")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans and kinds, in order, without overlaps."""
    found = [(m.start(1), m.end(1), "assigned") for m in ASSIGNED.finditer(text)]
    found += [(m.start(), m.end(), "shape") for m in SHAPES.finditer(text)]
    found += [(m.start(), m.end(), "run") for m in RUNS.finditer(text) if any(map(str.isdigit, m.group()))]
    found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
    kept: list[tuple[int, int, str]] = []
    for f in found:
        if kept and f[0] < kept[-1][1]:
            if f[1] - f[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = f
        else:
            kept.append(f)
    return kept


_CLASS = np.full(256, 3, np.uint8)  # digits, lower, upper, other
for _i, _letters in enumerate((b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _CLASS[list(_letters)] = _i


def _coverage(low: str) -> float:
    hit = bytearray(len(low))
    for w in DICTIONARY:
        at = low.find(w)
        while at >= 0:
            hit[at : at + len(w)] = b"\1" * len(w)
            at = low.find(w, at + 1)
    return sum(hit) / len(low)


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    n, low = len(s), s.lower()
    codes = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    classes = _CLASS[codes]
    share = np.bincount(classes, minlength=4) / n
    counts = np.bincount(codes)
    odds = counts[counts > 0] / n
    step = np.diff(codes.astype(np.int16))
    before = re.findall(r"[a-z0-9]+", text[max(0, start - 48) : start].lower())
    near = set(before[-5:])
    return [
        end - start,
        *map(float, share),
        float(-(odds * np.log2(odds)).sum()),
        float((classes[1:] != classes[:-1]).sum()) / max(1, n - 1),
        sum(map(low.count, "aeiouy")) / n,
        float((step == 0).sum()) / max(1, n - 1),
        _coverage(low),
        float(start > 0 and text[start - 1] in "/\\") + s.count("/") / n * 4,
        float(any(w in b for b in near for w in SECRET_WORDS)),
        float(any(w in near for w in OTHER_WORDS)),
        float(kind == "assigned"),
        float(kind == "shape"),
        float(not low.strip("0123456789abcdef")),
        float(share.max() == 1),
        float((step == 1).sum()) / max(1, n - 1),
    ]


def labelled_findings(n: int = 4000, seed: int = 5) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label): real shapes under secret words, and what scanners report wrongly."""
    rng = np.random.default_rng(seed)
    hexes, alnum, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    words = [w for w in DICTIONARY if w.isalpha() and len(w) > 2]
    prose = lambda k: " ".join(pick(words) + pick(words) for _ in range(k))
    real = (
        lambda: (f'{pick(["token", "secret", "api_key", "auth_token", "password", "access_key", "SECRET_KEY", "key"])}{pick([" = ", "=", ": ", ":"])}{pick(["", chr(34), chr(39)])}', draw(pick([hexes, alnum, b64]), int(rng.integers(16, 65)))),
        lambda: ("", "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
        lambda: (pick(["", "url ", "use "]), pick(["ghp_", "gho_"]) + draw(alnum, 36)),
        lambda: ("Authorization: Bearer ", draw(b64, int(rng.integers(24, 80)))),
        lambda: (pick(["", "jwt "]), "eyJ" + draw(alnum, 20) + "." + draw(alnum, 40) + "." + draw(alnum, 30)),
        lambda: (pick(["", "key ", "use "]), pick(["AIza" + draw(alnum + "_-", 35), "sk_live_" + draw(alnum, 24), "xoxb-" + draw("0123456789", 12) + "-" + draw(alnum, int(rng.integers(10, 25)))])),
        lambda: ("password = " + pick(["", '"']), draw(alnum + "!@#$%", int(rng.integers(10, 24)))),
    )
    false = (
        lambda: (pick(["commit ", "sha1 ", "sha256: ", "md5 ", "checksum ", "digest ", "etag "]), draw(hexes, pick([32, 40, 64]))),
        lambda: (pick(["uuid ", "guid: ", "", "id "]), "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: (pick(["", "order ", "invoice ", "isbn ", "number ", "token "]), draw("0123456789", int(rng.integers(16, 30)))),
        lambda: (pick(["/", "path /", "see /"]), "/".join(pick(words) + str(int(rng.integers(10))) for _ in range(int(rng.integers(4, 8))))),
        lambda: (pick(["", "class ", "call "]), "".join(pick(words).title() for _ in range(int(rng.integers(4, 8)))) + str(int(rng.integers(100)))),
        lambda: (pick(["token = ", "api_key: ", 'secret = "', "password="]), pick(["your-api-key-here", "xxxxxxxxxxxxxxxxxxxx", "changeme1234", "YOUR_SECRET_KEY_HERE", "example-token-1234", "placeholder_value_1", "12345678901234567890", "abcdefghijklmnopqrst", "test-password-123", "dummy_secret_value"])),
        lambda: (pick(["", "key ", "token = ", "use "]), pick(["AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 9) + "EXAMPLE", "ghp_" + pick("xX0") * 36, "sk_test_" + "your" + "example" * 2 + "key", "xoxb-" + "0" * 12 + "-your-token-here", "AIza" + "Example" * 5])),
        lambda: (pick(["the token ", "a secret ", "key ", "password "]), pick(words) + pick(words) + pick(words)),
        lambda: (pick(["", "token "]), pick(words) + draw("0123456789", 3) + pick(words) + pick(words) + pick(words)),
    )
    out = []
    for i in range(n):
        context, value = pick(real if i % 2 else false)()
        head = prose(int(rng.integers(1, 8))) + " " + context
        text = head + value + pick(["", '"', " "]) + " " + prose(3)
        kind = next((k for a, b, k in candidates(text) if a < len(head) + len(value) and b > len(head)), "run")
        out.append((text, len(head), len(head) + len(value), kind, i % 2))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tree: list) -> int:
    at = len(tree)
    tree.append([-1, 0.0, -1, -1, float(y.mean())])
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return at
    best = (y.var() * len(y) - 1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5 + 1)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.arange(1, len(t))
        s = np.cumsum(t)[:-1]
        rest = t.sum() - s
        cost = s - s * s / left + rest - rest * rest / (len(t) - left)
        cost[(v[1:] == v[:-1]) | (left < least) | (len(t) - left < least)] = np.inf
        i = int(np.argmin(cost))
        if cost[i] < best[0]:
            best = (cost[i], int(f), (v[i] + v[i + 1]) / 2)
    if best[1] < 0:
        return at
    low = x[:, best[1]] <= best[2]
    tree[at][:2] = best[1], best[2]
    tree[at][2] = _grow(x[low], y[low], rng, depth - 1, least, tree)
    tree[at][3] = _grow(x[~low], y[~low], rng, depth - 1, least, tree)
    return at


def train(findings: list[tuple[str, int, int, str, int]], trees: int = 50, depth: int = 9, least: int = 4, seed: int = 3) -> list[np.ndarray]:
    """A forest as arrays (feature, threshold, left, right, mean). Each tree sees a bootstrap sample."""
    x = np.array([features(*f[:4]) for f in findings])
    y = np.array([f[4] for f in findings], float)
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows, tree = rng.integers(0, len(y), len(y)), []
        _grow(x[rows], y[rows], rng, depth, least, tree)
        forest.append(np.array(tree))
    return forest


def vote(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = tree[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(low, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        total += tree[at, 4]
    return total / max(1, len(forest))


@functools.lru_cache(1)
def default_forest() -> list[np.ndarray]:
    return train(labelled_findings())


def _found(text: str, forest: list[np.ndarray]) -> list[tuple[int, int, str, float]]:
    spans = candidates(text)
    if not spans:
        return []
    return [(*s, float(p)) for s, p in zip(spans, vote(forest, np.array([features(text, *s) for s in spans])))]


def scan(docs: DataFrame, forest: list[np.ndarray] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row a candidate: doc_id, start, stop (characters), kind, score, is_secret."""
    forest = default_forest() if forest is None else forest

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, a, b, k, p, p >= threshold) for d, t in zip(frame["doc_id"], frame["text"]) for a, b, k, p in _found(t, forest)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop", "kind", "score", "is_secret"])

    return docs.select("doc_id", "text").filter(F.col("text").rlike(SIEVE)).mapInPandas(run, "doc_id long, start long, stop long, kind string, score double, is_secret boolean")


def redact(docs: DataFrame, forest: list[np.ndarray] | None = None, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """The rows with every secret replaced by ``mask``; all columns stay, texts without secrets are untouched."""
    forest = default_forest() if forest is None else forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = re.compile(SIEVE)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, t in enumerate(texts):
                if t and sieve.search(t):
                    for a, b, _, p in reversed(_found(t, forest)):
                        if p >= threshold:
                            t = t[:a] + mask + t[b:]
                    texts[i] = t
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
