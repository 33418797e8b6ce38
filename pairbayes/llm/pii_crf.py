"""Personal data: base patterns and a linear-chain conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers.  A conditional random field over the shapes of words finds more in
forms the patterns miss (spelled-out addresses, local phone numbers, grouped
card numbers with other separators).  It is trained from a small labelled table
of words and decoded by Viterbi for many word sequences at once in numpy.

A sequence is a stretch of words in which each word is at most ``REACH`` words
from a word with a digit or an at-sign, so a text without either costs a search
for them and nothing else.  Spans are in code points, end exclusive.  The
field's spans that touch a base span are dropped; base spans always stay.

Null and blank texts have no spans.  Repeated rows get the same spans each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairbayes.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
REACH = 2

#: The base patterns (fixed values).
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and without overlap for each kind."""
    out: list[tuple[int, int, str]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the local part reaches up to the sign, so its leftmost start is that of the run before it
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---------------------------------------------------------------- labelled table

#: Lines of the labelled table.  # stands for a digit, ~ for an invented word; [kind ...] is
#: labelled, the rest is not.  Each line is filled in ``COPIES`` ways by a seeded generator.
LINES = (
    "~ ~ [email ~.##@~.example.com] ~ ~", "~ [email ~@~.example.org], ~ ~ ~", "~ ~ [email ~ (at) ~ (dot) com] ~", "~ [email ~ [at] ~ [dot] org] ~ ~",
    "~ ~ [email ~_~##@~] ~ ~", "~ ~ [ip ##.###.#.###] ~ ~", "~ [ip ###.##.##.##], ~", "~ ~ [ip ###.###.###.###]", "~ [card ################] ~ ~",
    "~ ~ [card #### #### #### ####] ~", "~ [card ####-####-####-####] ~ ~", "~ ~ [card ####.####.####.####] ~", "~ [phone +# (###) ###-####] ~ ~",
    "~ ~ [phone +## ## ### ## ##] ~", "~ [phone (###) ###-####] ~ ~", "~ ~ [phone ###-###-####] ~ ~", "~ [phone +##########], ~ ~", "~ ~ [phone ###.###.####] ~",
    "~ ~ ~ ~ ~", "~ ~ version #.#. ~", "~ ~ #.#. ~ ~", "~ #### ~ ~", "~ ####-##-## ~ ~", "~ ##:## ~ ~", "~ ## ~ ## ~", "~ #,### ~ ~", "~ $##.## ~ ~",
    "~ ~ token = \"~##~####~##~##~####~#\" ~", "~ #. ~ #. ~", "~ ##% ~ ~", "~ ####-#### ~ ~", "~ ~ ##/##/#### ~", "~ #.## ~ #.## ~", "~ ~##~ ~", "~ @~ ~ ~", "~ ##,###,### ~",
    "~ ~ 3. ~", "~ ~ (####) ~ ~", "~ v#.##.# ~ ~", "~ ##x## ~ ~", "~ ######## ~ ~", "~ ~ ###### ~",
)
COPIES = 8


def labelled_rows(seed: int = 3) -> list[tuple[int, int, str, str]]:
    """(line, place, word, label): the labelled table, labels B-kind, I-kind and O."""
    rng, out, line = np.random.default_rng(seed), [], 0

    def fill(sign: str) -> str:
        if sign == "#":
            return str(rng.integers(10))
        if sign == "~":
            return "".join(rng.choice(list("aeinorstlhdu"), rng.integers(2, 9)))
        return sign

    for pattern in LINES:
        for _ in range(COPIES):
            at = 0
            for part in re.findall(r"\[(?:email|ip|card|phone) (?:[^\[\]]|\[at\]|\[dot\])*\],?|\S+", pattern):
                kind = part[1:].split(" ")[0] if part.startswith("[") and part[1:].split(" ")[0] in KINDS else None
                tail = "," if kind and part.endswith(",") else ""
                words = part.rstrip(",")[len(kind) + 2 : -1].split(" ") if kind else [part]
                for i, w in enumerate(words):
                    word = "".join(map(fill, w)) + (tail if i == len(words) - 1 else "")
                    out.append((line, at, word, f"{'I' if i else 'B'}-{kind}" if kind else "O"))
                    at += 1
            line += 1
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "line int, place int, word string, label string")


# ---------------------------------------------------------------- features

HASHED = 1 << 12
LABELS = ("O", *[f"{b}-{k}" for k in KINDS for b in "BI"])


def shape(word: str) -> str:
    """Letters as a or A, digits as 9, runs of letters as one; long runs of digits by their length."""
    return re.sub(r"a+|A+", lambda m: m.group()[0], re.sub(r"[A-Z]", "A", re.sub(r"[^\W\dA-Z_]", "a", re.sub(r"\d", "9", word[:64]))))


def word_features(word: str) -> list[str]:
    s = shape(word)
    digits = sum(c.isdigit() for c in word[:64])
    core = s.strip("(),;:!?\"'.[]")
    out = [f"s={s[:24]}", f"c={core[:24]}", f"d={min(digits, 20)}", f"k={'9' in s}{'a' in s.lower()}{'@' in s}{'.' in s}{'-' in s}{'+' in s}", f"e={s[:1]}{s[-1:]}", f"g={'.'.join(str(len(g)) for g in re.findall('9+', s))[:24]}"]
    return out + [f"w={word.lower()}"] if word.lower().strip(",") in ("(at)", "[at]", "(dot)", "[dot]", "version", "token", "=") else out


def hashed(features: list[str]) -> np.ndarray:
    return np.array([crc32(f.encode("utf-8", "replace")) % HASHED for f in features], np.int64)


def sequence_features(words: list[str]) -> list[np.ndarray]:
    """Hashed features of each word: its own, and its neighbours' core shape and digits."""
    own = [word_features(w) for w in words]
    ends = ["b=^"], ["b=$"]
    out = []
    for i, f in enumerate(own):
        before, after = own[i - 1] if i else ends[0], own[i + 1] if i + 1 < len(own) else ends[1]
        out.append(hashed(f + ["-" + x for x in before[1:3]] + ["+" + x for x in after[1:3]]))
    return out


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """Weights of features by label, and of label pairs."""

    emit: np.ndarray
    step: np.ndarray

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[f].sum(axis=0) for f in features])

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Best labels of each sequence, by Viterbi over all sequences of about one length at once."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = np.argsort([len(s) for s in sequences], kind="stable")
        a = 0
        while a < len(order):
            longest, b = len(sequences[order[a]]), a
            while b < len(order) and (b - a) < 512 and len(sequences[order[b]]) <= max(8, 2 * longest):
                b += 1
            group = order[a:b]
            n = np.array([len(sequences[i]) for i in group])
            score = np.zeros((len(group), int(n.max()), len(LABELS)))
            for j, i in enumerate(group):
                score[j, : n[j]] = self.scores(sequence_features(sequences[i]))
            best, back = score[:, 0] + self.step[-1], np.zeros((len(group), int(n.max()), len(LABELS)), np.int8)
            for t in range(1, int(n.max())):
                ways = best[:, :, None] + self.step[None, :-1]
                back[:, t] = ways.argmax(axis=1)
                live = (t < n)[:, None]
                best = np.where(live, ways.max(axis=1) + score[:, t], best)
            for j, i in enumerate(group):
                path = [int(best[j].argmax())]
                for t in range(int(n[j]) - 1, 0, -1):
                    path.append(int(back[j, t, path[-1]]))
                out[i] = np.array(path[::-1])
            a = b
        return out


def fit(rows: list[tuple[int, int, str, str]], epochs: int = 40, rate: float = 0.15, decay: float = 1e-4, seed: int = 1) -> Field:
    """Adagrad on the log likelihood; marginals by forward and backward sums."""
    lines: dict[int, list[tuple[str, str]]] = {}
    for line, _, word, label in sorted(rows):
        lines.setdefault(line, []).append((word, label))
    data = [(sequence_features([w for w, _ in s]), np.array([LABELS.index(y) for _, y in s])) for s in lines.values()]
    k = len(LABELS)
    emit, step = np.zeros((HASHED, k)), np.zeros((k + 1, k))
    seen_emit, seen_step = np.full((HASHED, k), 1e-6), np.full((k + 1, k), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            features, y = data[i]
            score = np.array([emit[f].sum(axis=0) for f in features])
            n = len(y)
            ahead, behind = np.zeros((n, k)), np.zeros((n, k))
            ahead[0] = score[0] + step[-1]
            for t in range(1, n):
                ahead[t] = score[t] + np.logaddexp.reduce(ahead[t - 1][:, None] + step[:-1], axis=0)
            for t in range(n - 2, -1, -1):
                behind[t] = np.logaddexp.reduce(step[:-1] + (score[t + 1] + behind[t + 1])[None, :], axis=1)
            log_z = np.logaddexp.reduce(ahead[-1])
            error = np.exp(ahead + behind - log_z)
            error[np.arange(n), y] -= 1
            g_step = decay * step
            g_step[-1] += error[0]
            for t in range(1, n):
                g_step[:-1] += np.exp(ahead[t - 1][:, None] + step[:-1] + (score[t] + behind[t])[None, :] - log_z)
                g_step[y[t - 1], y[t]] -= 1
            seen_step += g_step**2
            step -= rate * g_step / np.sqrt(seen_step)
            for f, e in zip(features, error, strict=True):
                g = e[None, :] + decay * emit[f]
                seen_emit[f] += g**2
                emit[f] -= rate * g / np.sqrt(seen_emit[f])
    return Field(emit, step)


# ---------------------------------------------------------------- over texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")
TRIM = "(),;:!?\"'.[]{}<>#$%&*|"


def sequences_of(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of words (spans) near a word with a digit, an at-sign or a spelled-out one."""
    marks = [m.start() for m in MARK.finditer(text)]
    if not marks:
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    starts = np.array([s for s, _ in spans])
    hits = np.unique(np.searchsorted(starts, marks, side="right") - 1)
    out: list[list[tuple[int, int]]] = []
    a, b = max(0, hits[0] - REACH), hits[0] + REACH + 1
    for h in hits[1:]:
        if h - REACH <= b:
            b = h + REACH + 1
        else:
            out.append(spans[a:b])
            a, b = h - REACH, h + REACH + 1
    return [*out, spans[a:b]]


def added_spans(text: str, words: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of the labelled runs, without the punctuation around them.  Runs too short or too
    long in digits for their kind are left out."""
    out, i = [], 0
    while i < len(labels):
        if labels[i] == 0:
            i += 1
            continue
        kind, j = LABELS[labels[i]][2:], i + 1
        while j < len(labels) and LABELS[labels[j]] == f"I-{kind}":
            j += 1
        start, end = words[i][0], words[j - 1][1]
        piece = text[start:end]
        lead = len(piece) - len(piece.lstrip(TRIM.replace("(", "").replace("[", "")))
        piece = piece.strip(TRIM.replace("(", "").replace("[", ""))
        digits = sum(c in DIGITS for c in piece)
        right = {"email": len(piece) >= 5 and (("@" in piece and piece[0] != "@" and piece[-1] != "@") or bool(re.search(r"[(\[]at[)\]]", piece))), "ip": piece.count(".") == 3 and 4 <= digits <= 12 and all(p.isascii() and p.isdigit() and int(p[:4]) <= 255 for p in piece.split(".")), "card": 15 <= digits <= 16 and luhn("".join(c for c in piece if c in DIGITS)), "phone": 10 <= digits <= 15 and not re.search(r"[^\d\s().+-]", piece)}
        if right[kind]:
            out.append((start + lead, start + lead + len(piece), kind))
        i = j
    return out


def all_spans(texts: list[str | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; sequences of all texts are decoded together."""
    base = [base_spans(t) if t else [] for t in texts]
    found = [(i, words) for i, t in enumerate(texts) if t for words in sequences_of(t)]
    labels = field.decode([[texts[i][a:b] for a, b in words] for i, words in found])
    extra: dict[int, list] = {}
    for (i, words), y in zip(found, labels, strict=True):
        for s in added_spans(texts[i], words, y):
            if all(s[1] <= b[0] or b[1] <= s[0] for b in base[i]):
                extra.setdefault(i, []).append(s)
    return [(b, sorted(b + extra.get(i, []), key=lambda s: (s[0], KINDS.index(s[2])))) for i, b in enumerate(base)]


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span as its kind's mark; spans that overlap become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = "array<struct<start:int,end:int,kind:string>>"


def find(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``found`` (arrays of start, end, kind) and ``masked`` text."""
    told = docs.sparkSession.sparkContext.broadcast(field or fit([tuple(r) for r in labelled_table(docs.sparkSession).collect()]))
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            texts = part.column(at).to_pylist()
            got = all_spans(texts, told.value)
            rows = [[[{"start": s, "end": e, "kind": k} for s, e, k in spans] for spans in g] for g in got]
            clean = [None if t is None else masked(t, g[1]) if g[1] else t for t, g in zip(texts, got, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind), pa.array(clean, pa.string())], names=[*part.schema.names, "base", "found", "masked"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, base {SPANS}, found {SPANS}, masked string")
