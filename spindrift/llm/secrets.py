"""Secret scans: wide candidates, narrowed by a random forest that has learned false findings.

A candidate is a value that looks random or has the form of a known credential, or that stands behind a word
such as "token" and an assignment. For each the forest sees its length, what its characters are and how they
follow each other, how much of it is made of dictionary words, whether it looks like a path, address or
identifier, and which words stand next to it. The dictionary is learned from the corpus, the weights of neighbouring
words from the labelled findings, pairs of texts and flags, as the forest is. Without own findings, a bounded set is
drawn from the formats of credentials and of their look-alikes.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import column, release
from ._trees import Trees, random_forest

FINDINGS = 6000
#: Words of the dictionary at most, the commonest of the corpus, and the letters that one has at least.
WORDS, LETTERS = 50_000, 4
#: Known forms of credentials (public formats). Each is looked for in time that follows the length of the text: a user name ends
#: at the first sign that none may hold, a password or key where the next one begins, and the parts of a token are measured
#: once, where its run of characters begins.
_B64 = "[0-9A-Za-z_-]"
FORMS = [
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), ("github", r"\bgh[pousr]_[0-9A-Za-z]{36}\b"), ("slack", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("jwt", rf"(?<!{_B64})(?={_B64}{{13,}}+\.eyJ{_B64}{{10,}}+\.{_B64}{{10}})(?:{_B64}*?-)??eyJ{_B64}{{10,}}+\.eyJ{_B64}{{10,}}+\.{_B64}{{10,}}"),
    ("url_password", r"(?<=://)[^\s:/@?#]++:(?:(?!://)[^\s@]){3,}+(?=@[0-9A-Za-z])"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?!-----)[\s\S]){20,}+-----END (?:[A-Z]+ )?PRIVATE KEY-----"),
]
CUES = ["token", "secret", "password", "passw0rd", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "client_secret", "bearer"]
CALM = ["sha256", "md5", "commit", "checksum", "integrity hash", "version id", "uuid", "digest"]
#: Words that stand in for a dictionary where no corpus has been read.
COMMON = ["the", "ing", "ion", "ent", "and", "tion", "ter", "est", "ers", "ati", "hat", "ate", "all", "ver", "his", "con", "res", "pro", "com", "per", "int", "our", "man", "ment", "ine", "one", "ous", "ther", "sch", "ein", "eau", "que", "pass", "word", "name", "user", "test", "key", "data", "file", "image", "index", "page"]
_CUE = "|".join(map(re.escape, CUES))
CANDIDATE = re.compile(
    "|".join(f"(?P<{n}>{p})" for n, p in FORMS)
    + rf"|(?i:(?:{_CUE})[\"']?\s{{0,3}}(?:=|:|:=|=>)\s{{0,3}}[\"']?)(?P<assigned>[^\s\"'<>,;]{{6,}}+)"
    + r"|(?<![0-9A-Za-z+/_=-])(?P<random>(?=[0-9A-Za-z+/_=-]*[0-9])(?=[0-9A-Za-z+/_=-]*[A-Za-z])[0-9A-Za-z+/_=-]{20,}+)")
#: Quick test of a text: nothing can be found without a word of so many characters and a digit, one of the stems
#: that all cues and private keys hold, or a start of a known form, which may have no digit.
LONG = 15
_DIGIT = re.compile("[0-9]")
STEMS = ("token", "secret", "passw", "pwd", "key", "auth", "credential", "bearer")
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "eyJ", "-----BEGIN", "://")
KINDS = [n for n, _ in FORMS] + ["assigned", "random"]
_RUN = re.compile(r"[^\W\d_]+")
_NEAR = re.compile(r"[^\W_]{2,}")
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z", re.I)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of all candidates, in order, none inside another."""
    # Folded, as the search without regard to case takes a long s for an s.
    low = text.casefold()
    if not any(x in low for x in STEMS) and not any(x in text for x in STARTS) and not _DIGIT.search(" ".join([w for w in text.split() if len(w) >= LONG])):
        return []
    return [(m.start(m.lastgroup), m.end(m.lastgroup), m.lastgroup) for m in CANDIDATE.finditer(text)]


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class Model(NamedTuple):
    """trees: the forest; words: the dictionary; near: log-odds of secrets behind words that stand in front."""

    trees: Trees
    words: frozenset[str]
    near: dict[str, float]


def worded(value: str, words: frozenset[str]) -> int:
    """Letters of a value that are covered by dictionary words, the longest taken first from the left."""
    covered = 0
    for run in _RUN.findall(value.lower()):
        at = 0
        while at <= len(run) - LETTERS:
            end = next((e for e in range(min(len(run), at + 24), at + LETTERS - 1, -1) if run[at:e] in words), 0)
            covered += max(0, end - at)
            at = end or at + 1
    return covered


def learn_words(docs: DataFrame, most: int = WORDS) -> frozenset[str]:
    """The commonest words of all texts, of LETTERS letters and more and seen three times at least, in lower case."""
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(LETTERS, 24))
    common = found.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "word").limit(most)
    return frozenset(common.select("word").toArrow().column("word").to_pylist())


def _front(text: str, begin: int) -> list[str]:
    return _NEAR.findall(text[max(0, begin - 40) : begin].lower())[-4:]


def neighbours(findings: list[tuple[str, int, int, str, int]]) -> dict[str, float]:
    """Log-odds of a secret behind each word that stands in front of some findings, with one added to both counts."""
    seen = (Counter(), Counter())
    for text, begin, _, _, label in findings:
        seen[label].update(set(_front(text, begin)))
    size = [1 + sum(f[4] == k for f in findings) for k in (0, 1)]
    return {w: math.log((seen[1][w] + 1) / size[1]) - math.log((seen[0][w] + 1) / size[0]) for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= 5}


def features(text: str, begin: int, end: int, kind: str, words: frozenset[str] = frozenset(COMMON), near: dict[str, float] | None = None) -> list[float]:
    value = text[begin:end]
    n = len(value)
    kinds = [_class(c) for c in value]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    count = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    repeat = sum(a == b for a, b in zip(value, value[1:], strict=False))
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:], strict=False))
    low = value.lower()
    before, after = text[max(0, begin - 40) : begin].lower(), text[end : end + 24].lower()
    weights = [(near or {}).get(w, 0.0) for w in _front(text, begin)]
    return [
        n, turns / n, entropy, entropy / math.log2(max(2, min(n, 64))), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        repeat / n, steps / n, worded(value, words) / n, float(all(c in "0123456789abcdef" for c in low)), float(bool(_UUID.match(value))), value.count("/") / n, value.count("-") + value.count("_"),
        sum(weights), max(weights, default=0.0), min(weights, default=0.0), float(any(w in low for w in ("example", "xxxx", "changeme", "placeholder", "dummy", "your_", "sample"))),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")), float("://" in before or "www." in before), float(after[:1] in "\"'"), float(KINDS.index(kind)), len(count) / n,
    ]


def drawn_findings(n: int = FINDINGS, seed: int = 7, vocabulary: frozenset[str] = frozenset(COMMON)) -> list[tuple[str, int, int, str, int]]:
    """Labelled findings (text, begin, end, kind, 1 for a secret) of known forms and look-alikes among words of a
    vocabulary, n at most."""
    r = random.Random(seed)
    pool = sorted(vocabulary) or COMMON
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, wide = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: r.choice(pool)
    words = lambda k: " ".join(word() for _ in range(k))
    secret = [
        lambda: ("AKIA" + pick(string.ascii_uppercase + string.digits, 16)), lambda: "ghp_" + pick(wide, 36), lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(wide, 24), lambda: "AIza" + pick(wide + "_-", 35),
        lambda: pick(hexes, r.choice([32, 40, 48, 64])), lambda: pick(wide, r.randint(20, 64)), lambda: base64.b64encode(r.randbytes(r.randint(18, 48))).decode(), lambda: pick(wide + "!#$%&*+?@", r.randint(9, 24)),
        lambda: word() + str(r.randint(1, 9999)) + r.choice("!#%&*?") + (word() if r.random() < 0.5 else ""), lambda: word() + str(r.randint(1, 9)) + word() + r.choice("!#%&*?"),
        lambda: "eyJ" + pick(wide, 30) + ".eyJ" + pick(wide, 40) + "." + pick(wide, 43),
    ]
    calm = [
        lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), lambda: word() + "_" + word() + "-" + word() + str(r.randint(1, 99)), lambda: "/".join([word(), word(), word(), str(r.randint(1, 9999))]), lambda: r.choice("0x1a") * r.randint(20, 40) + "1a",
        lambda: "your_" + word() + "_token_here1", lambda: "EXAMPLE" + word().upper() + str(r.randint(1, 9)) + word(), lambda: "abcdefghijklmnopqrstuvwxyz0123456789"[: r.randint(21, 36)], lambda: word() + word().title() + word().title() + word().title() + str(r.randint(1, 20)),
        lambda: "changeme" + str(r.randint(1, 99)), lambda: pick("0123456789", 24) + "a", lambda: "=" * r.randint(18, 30) + "1a",
    ]
    out = []
    while len(out) < n:
        positive = r.random() < 0.5
        made = r.choice(secret if positive else calm)
        value = made()
        # Passwords made of words stand behind words for passwords only.
        cue = r.choice(("password", "passwd", "pwd") if made in (secret[8], secret[9]) else CUES)
        if positive and r.random() < 0.06:
            lead = r.choice(["postgres", "mysql", "https", "amqp"]) + "://"
            value = word() * r.choice([1, 1, 1, 8]) + ":" + value.replace("@", r.choice("x/#?")) + "@host1"
        elif positive and r.random() < 0.02:
            lead = words(r.randint(0, 3)) + "\n"
            kind = r.choice(["", "RSA ", "EC "])
            value = f"-----BEGIN {kind}PRIVATE KEY-----\n{pick(wide + '+/', r.randint(40, 400))}\n-----END {kind}PRIVATE KEY-----"
        elif positive and made in (secret[8], secret[9]):
            lead = r.choice([f'{cue} = "', f"{cue}: ", f'"{cue}": "', f"{cue}=", f"export {cue.upper()}="])
        elif positive:
            lead = r.choice([f'{cue} = "', f"{cue}: ", f'"{cue}": "', f"{cue}=", f"export {cue.upper()}=", words(2) + f' {cue} = "', "Authorization: Bearer ", words(3) + " "])
        elif r.random() < 0.06:
            # A port and a path with an address behind it look like a user and a password.
            lead = r.choice(["http", "https"]) + "://"
            value = f"{r.choice(['www.', ''])}{word()}.{r.choice(['com', 'org', 'net'])}:{r.choice([80, 443, 8000, 8080, 8443, 3000])}/{word()}{r.choice(['/', '?q=', '#', '?mail='])}{word()}@{word()}.com"
        elif r.random() < 0.25:
            # A checksum has a secret's form but not its neighbours.
            value = pick(hexes, r.choice([32, 40, 64]))
            lead = r.choice(CALM) + r.choice([": ", " = ", " "])
        else:
            lead = r.choice([words(3) + " ", f'{cue} = "', "path: ", "file = ", "id: ", 'src="', "https://" + word() + ".example.com/"])
        text = words(r.randint(0, 6)) + " " + lead + value + r.choice(['" ', " ", '"\n', "\n"]) + words(r.randint(0, 6))
        begin = text.rindex(value)
        for a, b, kind in candidates(text):
            if a < begin + len(value) and b > begin:
                out.append((text, a, b, kind, int(positive)))
    return out[:n]


def train(findings: list[tuple[str, int, int, str, int]] | None = None, words: frozenset[str] = frozenset(COMMON)) -> Model:
    """Model from labelled findings (text, begin, end, kind, 0 or 1) and a dictionary; by default from drawn ones. A
    third of them gives the weights of neighbouring words, the rest the forest."""
    findings = (findings or drawn_findings(vocabulary=words))[:FINDINGS]
    near = neighbours(findings[::3])
    rest = [f for k, f in enumerate(findings) if k % 3] or findings
    x = np.array([features(*f[:4], words, near) for f in rest])
    return Model(random_forest(x, np.array([f[4] for f in rest])), words, near)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


def found_in(text: str, model: Model, level: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(begin, end, kind, probability) of the candidates of a text that the forest takes for secrets."""
    spots = candidates(text)
    if not spots:
        return []
    p = model.trees.probability(np.array([features(text, *s, model.words, model.near) for s in spots]))
    return [(*s, float(x)) for s, x in zip(spots, p, strict=True) if x >= level]


def masked(text: str, spots: list[tuple[int, int, str, float]]) -> str:
    out, at = [], 0
    for begin, end, kind, _ in spots:
        out += [text[at:begin], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, n_candidates int, n_secrets int, secrets array<struct<begin:int,end:int,kind:string,probability:double>>, masked string"


def scan(docs: DataFrame, model: Model | None = None, level: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Secrets of every whole text: SCHEMA, and the columns named in ``keep``.

    begin and end count characters. ``masked`` is the text with each secret replaced by its kind in brackets,
    null if nothing was found. Null and empty texts have none. Rows are kept, with null or repeated ids. Without a
    model, one is trained with the dictionary of all texts of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(words=learn_words(docs)))
    others = [f.name for f in docs.schema if f.name in (keep or []) and f.name != "doc_id"]
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            spots = [candidates(t) for t in texts]
            trees, words, near = shared.value
            rows = [features(t, *s, words, near) for t, found in zip(texts, spots, strict=True) for s in found]
            p = iter(trees.probability(np.array(rows)).tolist() if rows else ())
            kept_ = [[(*s, x) for s in found if (x := next(p)) >= level] for found in spots]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(s) for s in spots], pa.int32()), pa.array([len(s) for s in kept_], pa.int32()),
                 pa.array([[dict(zip(("begin", "end", "kind", "probability"), s, strict=True)) for s in found] for found in kept_], kind),
                 pa.array([masked(t, found) if found else None for t, found in zip(texts, kept_, strict=True)], pa.string()), *(column(batch, x) for x in others)],
                ["doc_id", "n_candidates", "n_secrets", "secrets", "masked", *others])
            release()

    sources = ["doc_id", *others, *(["text"] if "text" not in others else [])]
    return docs.select(*sources).mapInArrow(run, SCHEMA + kept)
