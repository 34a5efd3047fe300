"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Base spans are those of the four patterns. Around digits, at signs and spelled ones (bracketed, or bare before a host) a text is cut into islands of tokens. The field
scores whole candidate segments of an island, up to LONGEST tokens, by features of the span as a unit (its digits,
separators, checksum, shape, the word before); dynamic programming over segment ends chooses boundaries and kinds
jointly. It is trained by maximum likelihood, forward and backward over all segmentations, on the islands of a bounded
sample (FIT_DOCS documents): base spans are the truth, and copies of them in other notations, made by rule, teach
it forms that the patterns don't take (user (at) host dot org, numbers without +, with other separators), and decoys in their
place what is none. Spans of the field
that don't touch a base span are added.

Cases: a null text is empty; texts without digits and at signs, spelled or not, have no spans and aren't scored; repeated rows get equal
results; without base spans to learn from only the patterns are used; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.llm.common import pick, pieces

KINDS = ("email", "ip", "card", "phone")
#: Documents that islands to learn from are taken from, at most; islands among them; tokens of a segment.
FIT_DOCS, FIT_ISLANDS, LONGEST = 4000, 600, 8

# Fixed patterns of the base. A number of dotted parts can start only where a run of digits does.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the whole pattern finds them, in linear time: a match starts as far before its @ as its characters and the match before allow."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end, in the order of KINDS and starts."""
    if not _TRIGGER.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# -- islands

_TRIGGER = re.compile("[0-9@]")
_TOKEN = re.compile(r"\S+")
#: A bracketed at or dot, or a bare at before a host, in letters of any case; for Python's re and for Arrow, without what only one of them knows.
_BLANKS = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WORDS = _BLANKS.replace("[", "[^.\\[({<", 1)
SPOKEN = rf"(?i)[\[({{<]{_BLANKS}*(?:at|dot){_BLANKS}*[\])}}>]|(?:^|{_BLANKS})at{_BLANKS}+{_WORDS}+(?:{_BLANKS}*(?:\.|[\[({{<]{_BLANKS}*dot{_BLANKS}*[\])}}>]){_BLANKS}*|{_BLANKS}+dot{_BLANKS}+){_WORDS}"
_SPOKEN = re.compile(SPOKEN)
#: "at a dot", all bare, is of a sentence.
_ARTICLE = re.compile(r"\s?at\s+(a|an|the)\s+dot\s", re.I)
_LINK = frozenset(("at", "dot", "(at)", "(dot)", "[at]", "[dot]", "<at>", "<dot>", "{at}", "{dot}", ".", "-", "/", ":"))
_OPEN, _CLOSE = "\"'<[{“«", "\"'>]},;:!?.“”»"


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens (start, end) with a digit, an at sign or a linking word, each with a neighbour on both sides."""
    hot = [m.start() for m in _TRIGGER.finditer(text)]
    hot += [m.start() + m.group()[0].isspace() for m in _SPOKEN.finditer(text) if not _ARTICLE.match(m.group())]
    out: list[list[tuple[int, int]]] = []
    done = -1
    for p in sorted(hot):
        if p < done:
            continue
        a = p
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        sides: dict[int, list[tuple[int, int]]] = {-1: [_TOKEN.match(text, a).span()]}
        sides[1] = sides[-1][:]
        for step, side in sides.items():
            extra = 0
            while True:
                span = _before(text, side[-1][0]) if step < 0 else _after(text, side[-1][1])
                if span is None or (step < 0 and span[0] < done):
                    break
                word = text[span[0] : span[1]]
                linked = _TRIGGER.search(word) or word.lower() in _LINK
                extra = 0 if linked else extra + 1
                if extra > 2 - (step > 0):
                    break
                side.append(span)
        out.append(sides[-1][:0:-1] + sides[1])
        done = sides[1][-1][1]
    return out


def _before(text: str, at: int) -> tuple[int, int] | None:
    b = at
    while b > 0 and text[b - 1].isspace():
        b -= 1
    a = b
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    return (a, b) if a < b else None


def _after(text: str, at: int) -> tuple[int, int] | None:
    m = _TOKEN.search(text, at)
    return m.span() if m else None


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without quotes and punctuation around it."""
    while a < b and text[a] in _OPEN:
        a += 1
    while a < b and text[b - 1] in _CLOSE and not (text[b - 1] in "])}>" and any(c in text[a:b] for c in "[({<")):
        b -= 1
    return a, b


_NAMES = (
    "bias", "one token", "two tokens", "3-4 tokens", "5+ tokens", "no digit", "1-3 digits", "4-6 digits", "7-11 digits", "12-15 digits", "16-19 digits", "20+ digits", "luhn of 16-19", "starts +", "starts 00", "starts (",
    "has @", "ends in host", "one @ and host", "at word", "dot word", "dots 1-2", "dots 3", "dots 4+", "four parts to 255", "four parts bare", "dashes", "blanks", "slashes or colons", "brackets", "no letter", "letters only", "letters and digits",
    "hex token", "mostly digits", "groups of 4", "short", "medium", "long", "quoted", "equals before", "first token plain", "last token plain", "local at host", "phone groups", "equal sizes",
)
_NEVER = -1e6


_AT, _DOT = re.compile(r"[\[({<]?\bat\b[\])}>]?", re.I), re.compile(r"[\[({<]?\bdot\b[\])}>]?", re.I)
_SPELLED = re.compile(r"[\w.%+-]+\s*(@|[\[({<]\s*at\s*[\])}>]|\sat\s)\s*[\w-]+(\s*(\.|[\[({<]\s*dot\s*[\])}>]|\sdot\s)\s*[A-Za-z0-9-]+)+", re.I)


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> np.ndarray:
    """Of the segment of tokens i to j, j exclusive."""
    a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    n, d, words = j - i, len(digits), s.split()
    groups = re.findall("[0-9]+", s)
    bare = re.sub(r"[\[\](){}<>\s]", "", s)
    parts = bare.split(".")
    four = len(parts) == 4 and all(x.isdigit() and len(x) < 6 and int(x) <= 255 for x in parts)
    plain = lambda w: w.isalpha() and w.lower() not in ("at", "dot")
    dots = s.count(".")
    known = (
        True, n == 1, n == 2, 3 <= n <= 4, n >= 5, d == 0, 1 <= d <= 3, 4 <= d <= 6, 7 <= d <= 11, 12 <= d <= 15, 16 <= d <= 19, d >= 20, 16 <= d <= 19 and luhn(digits), s.startswith("+"), s.startswith("00"), s.startswith("("),
        "@" in s, bool(re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", s)), s.count("@") == 1 and "." in s.rpartition("@")[2], bool(_AT.search(s)), bool(_DOT.search(s)), 1 <= dots <= 2, dots == 3, dots > 3, four and letters == 0, four and letters == 0 and n == 1,
        "-" in s, " " in s, "/" in s or ":" in s, any(c in s for c in "()[]{}"), letters == 0 and bool(s), letters > 0 and d == 0, letters > 0 and d > 0,
        n == 1 and len(s) >= 12 and letters > 0 and d > 0 and "@" not in s and s.isalnum(), d * 2 > len(s), len(groups) >= 3 and all(len(x) == 4 for x in groups), len(s) < 7, 7 <= len(s) < 20, len(s) >= 20,
        text[tokens[i][0]] in "\"'" or "=" in s, i > 0 and text[tokens[i - 1][0] : tokens[i - 1][1]].endswith(("=", ":")), plain(words[0]) if words else False, plain(words[-1]) if words else False, bool(_SPELLED.fullmatch(s)),
        letters == 0 and 8 <= d <= 15 and len(groups) >= 3 and len(groups[-1]) >= 4 and not four, len(groups) >= 2 and len(set(map(len, groups))) == 1,
    )
    return np.array(known, np.float64)


class Field:
    """A semi-Markov field over islands: a segment is of one kind, or a single token outside all kinds (label 0)."""

    def __init__(self):
        self.w = np.zeros((len(_NAMES), len(KINDS) + 1))

    @staticmethod
    def segments(text: str, tokens: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of all segments, by end, and their features."""
        where = [(i, j) for j in range(1, len(tokens) + 1) for i in range(max(0, j - LONGEST), j)]
        return np.array(where), np.stack([features(text, tokens, i, j) for i, j in where])

    def scores(self, where: np.ndarray, x: np.ndarray) -> np.ndarray:
        s = x @ self.w
        s[where[:, 1] - where[:, 0] > 1, 0] = _NEVER
        return s

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """Spans of the best segmentation."""
        where, x = self.segments(text, tokens)
        s = self.scores(where, x)
        kind, value = s.argmax(1), s.max(1)
        best, back = [0.0] + [-np.inf] * len(tokens), [None] * (len(tokens) + 1)
        for k, (i, j) in enumerate(where.tolist()):
            if best[i] + value[k] > best[j]:
                best[j], back[j] = best[i] + value[k], (i, int(kind[k]))
        out, j = [], len(tokens)
        while j > 0:
            i, label = back[j]
            if label:
                a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
                if a < b:
                    out.append((KINDS[label - 1], a, b))
            j = i
        return out[::-1]

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 120) -> "Field":
        """data: segments, features, and the true label of each segment or -1. Adam on the mean log likelihood."""
        slope = self.gradient(data)
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for step in range(1, steps + 1):
            g = 1e-4 * self.w + slope()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def gradient(self, data: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """A function that gives the slope of the mean negative log likelihood: forward and backward over all islands at once."""
        where, x, truth = (np.concatenate(part) for part in zip(*data, strict=True))
        island = np.repeat(np.arange(len(data)), [len(w) for w, *_ in data])
        begin, end = where.T
        tokens = np.array([int(w[:, 1].max()) for w, *_ in data])
        most, every = int(tokens.max()), np.arange(len(data))
        wide = end - begin > 1
        right = np.flatnonzero(truth >= 0)
        wanted = np.zeros_like(self.w)
        np.add.at(wanted.T, truth[right], x[right])

        def slope() -> np.ndarray:
            s = x @ self.w
            s[wide, 0] = _NEVER
            top = s.max(1)
            grid = np.full((len(data), most + 1, LONGEST + 1), -np.inf)  # by island, end and length
            grid[island, end, end - begin] = top + np.log(np.exp(s - top[:, None]).sum(1))
            alpha, beta = np.full((len(data), most + 1), -np.inf), np.full((len(data), most + 1), -np.inf)
            alpha[:, 0] = beta[every, tokens] = 0.0
            for j in range(1, most + 1):
                n = np.arange(1, min(LONGEST, j) + 1)
                alpha[:, j] = np.logaddexp.reduce(alpha[:, j - n] + grid[:, j, n], axis=1)
            for i in range(most - 1, -1, -1):
                n = np.arange(1, min(LONGEST, most - i) + 1)
                beta[:, i] = np.logaddexp(beta[:, i], np.logaddexp.reduce(beta[:, i + n] + grid[:, i + n, n], axis=1))
            p = np.exp(s + (alpha[island, begin] + beta[island, end] - alpha[island, tokens[island]])[:, None])
            return (x.T @ p - wanted) / len(data)

        return slope

    def marginals(self, where: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Probability of each segment with each label."""
        s = self.scores(where, x)
        top = s.max(1)
        each = top + np.log(np.exp(s - top[:, None]).sum(1))
        n = int(where[:, 1].max())
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        pairs = where.tolist()
        for k, (i, j) in enumerate(pairs):
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + each[k])
        for k in reversed(range(len(pairs))):
            i, j = pairs[k]
            beta[i] = np.logaddexp(beta[i], beta[j] + each[k])
        return np.exp(s + (alpha[where[:, 0]] + beta[where[:, 1]] - alpha[n])[:, None])


def variants(kind: str, s: str, k: int) -> list[str]:
    """Other notations of a span of the base, by rule; k varies them."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        user, _, host = s.partition("@")
        if k % 2:  # names with digits and without
            user = re.sub("[0-9]+", "", user).strip(".-_+%") or user
        return [f"{user} (at) {host.replace('.', ' (dot) ')}", f"{user} at {host.replace('.', ' dot ')}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user} @ {host}", f"{user} at {host}"][k % 5 :][:1]
    if kind == "ip":
        return [s.replace(".", "[.]"), s.replace(".", " . "), s.replace(".", "(.)")][k % 3 :][:1]
    if kind == "card":
        sep = "./-"[k % 3] if k % 2 else " "
        return [sep.join(digits[a : a + 4] for a in range(0, len(digits), 4))]
    return [s.lstrip("+"), "00" + s.lstrip("+"), re.sub("[^0-9]+", "/", s.lstrip("+")), re.sub("[^0-9]+", ".", s.lstrip("+"))][k % 4 :][:1]


def decoys(kind: str, s: str, k: int) -> str:
    """What has some of the look of a span and is none; k varies it."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        host = s.partition("@")[2]
        return f"{host.split('.')[0]} {k % 100}"
    if kind == "ip":
        return (".".join(s.split(".")[:2]), ".".join(s.split(".")[:3]), s.replace(".", " ", 2))[k % 3]
    if kind == "card":
        return (digits[:6], f"{digits[:4]} and {digits[4:8]}", f"{digits[:2]}.{digits[2:4]}")[k % 3]
    return (digits[:4], f"{digits[:4]} and {digits[-4:]}", f"{digits[:3]} of {digits[:3]}", f"{digits[:3]}-{digits[3:6]}", f"{digits[:2]}/{digits[2:4]}/{digits[-4:]}")[k % 5]


def examples(texts: list[str], most: int = FIT_ISLANDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Islands with the truth, as they are and in other notations."""
    data: list = []
    seen = dict.fromkeys(KINDS, 0)
    for text in texts:
        spans = base_spans(text)
        for tokens in islands(text):
            if len(data) >= most:
                return data
            lo, hi = tokens[0][0], tokens[-1][1]
            if len(tokens) > 40 or not _TRIGGER.search(text, lo, hi):
                continue  # to learn from; decode() takes islands of any length, and those that the base can't judge
            inside = [(kind, a, b) for kind, a, b in spans if lo <= a and b <= hi]
            taken: list[tuple[str, int, int]] = []
            for x in inside:
                if all(x[2] <= y[1] or y[2] <= x[1] for y in taken):
                    taken.append(x)
            _add(data, text, tokens, taken)
            for kind, a, b in taken[:2]:
                seen[kind] += 1
                k = seen[kind]
                for other in variants(kind, text[a:b], k):
                    line = text[lo:a] + other + text[b:hi]
                    span = (kind, a - lo, a - lo + len(other))
                    _add(data, line, [m.span() for m in _TOKEN.finditer(line)], [span])
                line = text[lo:a] + decoys(kind, text[a:b], k) + text[b:hi]
                if not base_spans(line):
                    _add(data, line, [m.span() for m in _TOKEN.finditer(line)], [])
    return data


def _add(data: list, text: str, tokens: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> None:
    where, x = Field.segments(text, tokens)
    truth = np.full(len(where), -1)
    row = {(i, j): k for k, (i, j) in enumerate(where.tolist())}
    inside = set()
    for kind, a, b in spans:
        held = [t for t, (p, q) in enumerate(tokens) if p < b and a < q]
        k = row.get((held[0], held[-1] + 1)) if held else None
        if k is None or inside & set(held):
            return  # no segmentation has this span
        truth[k] = KINDS.index(kind) + 1
        inside.update(held)
    for t in range(len(tokens)):
        if t not in inside:
            truth[row[t, t + 1]] = 0
    data.append((where, x, truth))


def find(text: str, field: Field | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The spans of the base, and those that the field adds, both by kind and start."""
    base = base_spans(text)
    if field is None:
        return base, []
    more = []
    for tokens in islands(text):
        if len(tokens) >= 1:
            more += [x for x in field.decode(text, tokens) if all(x[2] <= a or b <= x[1] for _, a, b in base)]
    return base, sorted(set(more), key=lambda x: (KINDS.index(x[0]), x[1]))


def train(docs: DataFrame, most: int = FIT_DOCS) -> Field | None:
    own = pick(docs, doc_id="long", text="string").where("text IS NOT NULL")
    few = own.select(F.col("doc_id").alias("of")).where("of IS NOT NULL").orderBy(F.xxhash64("of"), "of").limit(most).distinct()
    rows = own.join(F.broadcast(few), F.col("doc_id") == F.col("of")).where(F.col("text").rlike("[0-9@]"))
    texts = [r["text"] for r in rows.select("text").orderBy(F.xxhash64("doc_id"), "text").limit(most).collect()]
    data = examples(texts)
    return Field().fit(data) if any((t > 0).any() for *_, t in data) else None


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, spans (array of kind, start, end, base) of every document; places are code points."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, **options))  # a weight for each feature and kind
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def rows(batches):
        for batch in pieces(batches):
            text = batch.column("text")
            hot = pa.compute.fill_null(pa.compute.match_substring_regex(text, f"[0-9@]|{SPOKEN}"), False).to_pylist()
            out = [[]] * batch.num_rows
            for k in np.flatnonzero(hot).tolist():
                base, more = find(text[k].as_py(), field.value)
                out[k] = [{"kind": x, "start": a, "end": b, "base": own} for part, own in ((base, True), (more, False)) for x, a, b in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return pick(docs, doc_id="long", text="string").mapInArrow(rows, "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    text = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k")))), lambda s: F.concat_ws(":", s["k"], s["a"], s["b"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
