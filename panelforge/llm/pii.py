"""Personal data in texts, by weak supervision.

Strict patterns give the base spans, which always stay. Broad candidates are found beside them: every run of digits with
what people put between them, and everything around a sign that may stand for @. Labelers vote on each candidate and each
base span: for (1), against (2) or not at all (0). One votes by the strict pattern, others by format, check digit, lists of
endings and prefixes in use (gazetteer), the nearest telling word before the span, what touches it, variety, grouping, and
whether it is a date or time. Each speaks only where it has something to say, so none carries the rest. The votes of all spans in all texts are
counted by pattern of votes, a table whose size the number of labelers bounds. Expectation-maximisation over it estimates
each labeler's reliability, within bounds on how often it may be wrong, and each pattern's chance to be personal data.
A logistic span classifier for each kind is trained on these chances as soft labels. It sees the span and its surroundings: shape, length,
variety, characters and words beside it, and what the labelers say of it, so it judges shapes that it hasn't met as well.
Candidates that it accepts become spans if they touch no base span.

Null texts count as empty, and bytes that are no UTF-8 as replacement characters. Texts are read whole, each scan in linear
time. Ties between candidates that overlap go to the earlier, then the longer. With no candidate at all nothing is trained
and nothing added; an empty table gives an empty result. Repeated rows get equal results; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, out_batch, valid_text, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does: from within the run it would fail as from its start.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Signs of a disguised or broken address, and what may stand for a domain after one.
AT = re.compile(r"@|[\[({] ?at ?[\])}]|(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9-]+(?: dot |\.)[A-Za-z])", re.I)
DOT = r" ?(?:\.|[\[({] ?dot ?[\])}]| dot ) ?"
LOOSE_DOMAIN = re.compile(rf" ?[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
#: Runs of digits and of what people put between them; a dot in brackets is one of a disguised ip.
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().,/_\xa0-]{0,3}[0-9]|\[\.\][0-9])*")
#: Endings of host names in use beside all of two letters, and some of files.
ENDINGS = frozenset("com org net edu gov mil int info biz name pro mobi jobs travel app dev cloud online shop site store tech blog".split())
FILES = frozenset("txt html htm pdf png jpg jpeg gif csv json xml yaml yml md log conf cfg ini exe dll zip tar gz py js cpp java".split())
#: Country codes of telephone numbers: those of one and two digits, and the first two digits of those with three.
COUNTRY = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
COUNTRY_TENS = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
#: Ranges of the first four digits of cards in use.
ISSUERS = ((3000, 3059), (3400, 3499), (3528, 3589), (3600, 3699), (3700, 3799), (3800, 3999), (4000, 4999), (5000, 5099), (5100, 5599), (5600, 5899), (6011, 6011), (6200, 6299), (6304, 6304), (6440, 6599), (6759, 6763), (2221, 2720))
#: Words that labelers look for among the last BEFORE words: of each kind, and of what isn't personal data.
NEAR = {
    "email": frozenset("mail email e-mail contact write reach".split()),
    "ip": frozenset("ip host server address login".split()),
    "card": frozenset("card visa mastercard credit payment account".split()),
    "phone": frozenset("phone telephone tel tel. call mobile cell fax contact ring dial".split()),
}
AGAINST = frozenset("token hash version isbn serial key sha order invoice id no. nr. # ref ref. reference ticket batch sku part build page line total price amount model release".split())
BEFORE = 4
#: Dates and times, as whole candidates or as they begin.
TIME = re.compile(r"(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2}))(?:[ ,T]{1,2}[0-9]{1,4})?$|(?:19|20)[0-9]{6}(?:[ T]?[0-9]{4,6})?$")
#: How telephone numbers and cards are grouped.
PHONE_GROUPS = re.compile(r"(?:[0-9]{1,4} )?(?:[0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}|[0-9]{1,4}(?: [0-9]{2}){3,4}|[0-9]{2,5} [0-9]{5,8})$")
CARD_GROUPS = re.compile(r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}(?: [0-9]{1,3})?$|[0-9]{4} [0-9]{6} [0-9]{5}$")
#: Characters looked at before and after a candidate.
AROUND = 32
LABELERS = ["pattern", "format", "check digit", "gazetteer", "words", "border", "spread", "grouping", "time"]
#: Buckets of the classifier's features, candidates of each kind that it is trained on at most, and its steps.
BUCKETS, SAMPLE, STEPS = 1024, 4000, 400
#: How often a labeler may at most be wrong: vote for what is no personal data, and against what is.
MOST_WRONG = ((0.05, 1.0), (1.0, 0.05), (0.15, 0.005), (1.0, 0.1), (0.1, 0.02), (1.0, 0.05), (1.0, 0.05), (1.0, 0.2), (1.0, 0.005))
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"
SEEN = "kind int, pattern string, n long, hash long, features array<int>"

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The strict matches, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(start, 0, end) for start, end in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def loose_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates beside the base spans, none overlapping a base span or another candidate."""
    out: list[Span] = []
    if "@" in text or " at " in text or "at]" in text or "at)" in text or "at}" in text:
        done = 0
        for m in AT.finditer(text):
            start = m.start() - (1 if m.start() > done and text[m.start() - 1] == " " and m[0] != " at " else 0)
            first = start
            while first > done and text[first - 1] in LOCAL:
                first -= 1
            found = LOOSE_DOMAIN.match(text, m.end()) if first < start else None
            if found:
                out.append((first, 0, found.end()))
                done = found.end()
    if DIGIT.search(text):
        for m in NUMBER.finditer(text):
            parts = re.findall(r"[0-9]+", m[0])
            digits = sum(map(len, parts))
            if len(parts) == 4 and max(map(len, parts)) <= 3 and ("." in m[0] or "," in m[0]):
                out.append((m.start(), 1, m.end()))
            else:
                out.append((m.start(), 2 if 13 <= digits and not m[0].startswith(("+", "00")) else 3, m.end()))
    if not out:
        return out
    taken, kept = sorted((s, e) for s, _, e in base), []
    i, last = 0, 0
    for start, kind, end in sorted(out, key=lambda x: (x[0], -x[2], x[1])):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start >= last and not (i < len(taken) and taken[i][0] < end):
            kept.append((start, kind, end))
            last = end
    return kept


def country(digits: str) -> bool:
    """Whether digits begin with a country code."""
    return digits[:1] in COUNTRY or digits[:2] in COUNTRY or digits[:2] in COUNTRY_TENS


def word_before(before: str, kind: int) -> int:
    """1 if the nearest telling word before a span is one of its kind, 2 if it is one that speaks against it, 0 if there is none."""
    for word in reversed(before.replace(":", " ").replace("=", " ").split()[-BEFORE:]):
        if word in NEAR[KINDS[kind]]:
            return 1
        if word in AGAINST:
            return 2
    return 0


def votes(text: str, span: Span, strict: bool) -> tuple[int, ...]:
    """What each labeler says of a span: 1 for, 2 against, 0 nothing. strict: whether it is a base span."""
    start, kind, end = span
    own = text[start:end]
    digits = "".join(c for c in own if "0" <= c <= "9")
    before = text[max(0, start - AROUND) : start].lower()
    form = check = known = spread = groups = time = 0
    if kind == 0:
        ending = re.split(DOT, own, flags=re.I)[-1].strip(" .").lower()
        form = 1 if len(ending) >= 2 and ending.isalpha() else 2
        known = 2 if ending in FILES or not ending.isalpha() else 1 if len(ending) == 2 or ending in ENDINGS else 0
        spread = 2 if len(set(own.lower())) < 6 else 0
    elif kind == 1:
        parts = re.findall(r"[0-9]+", own)
        sound = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
        form = 1 if sound else 2
        check = 2 if any(len(p) > 1 and p[0] == "0" for p in parts) else 0
        known = 0 if not sound else 2 if int(parts[0]) in (0, 127) or int(parts[0]) > 223 else 1
        spread = 2 if len(set(parts)) < 3 else 0
        groups = 2 if "," in own else 0
    else:
        spaced = re.sub(r"[^0-9]+", " ", own).strip()
        if kind == 2:
            form = 0 if 14 <= len(digits) <= 19 else 2
            check = 1 if luhn(digits) else 2
            known = 1 if any(lo <= int(digits[:4]) <= hi for lo, hi in ISSUERS) else 2
            spread = 2 if len(set(digits)) < 5 else 0
            groups = 1 if CARD_GROUPS.match(spaced) else 2 if " " in spaced else 0
        else:
            form = 1 if 10 <= len(digits) <= 15 else 0 if 8 <= len(digits) <= 9 else 2
            lead = digits[2:] if digits.startswith("00") else digits
            abroad = own.startswith(("+", "00"))
            known = (1 if country(lead) else 2) if abroad else 1 if own.startswith("(") else 0
            spread = 2 if len(set(digits)) < 4 else 0
            groups = 1 if PHONE_GROUPS.match(spaced) else 2 if " " in spaced else 0
        time = 2 if TIME.match(own.strip(" ,.")) or text[end : end + 1] == ":" and text[end + 1 : end + 2].isdigit() or start and text[start - 1] == ":" else 0
    glued = (start and (text[start - 1].isalnum() or text[start - 1] in "_#=\"'-$€")) or (end < len(text) and (text[end].isalnum() or text[end] in "_\"'-%"))
    return int(strict), form, check, known, word_before(before, kind), 2 if glued else 0, spread, groups, time


def features(text: str, span: Span) -> list[int]:
    """Buckets of what the classifier goes by: the span's shape, length and variety, the characters and words beside it, and what the labelers but the strict pattern say."""
    start, kind, end = span
    own = text[start:end]
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", lambda m: f"d{len(m[0])}", own.lower()))
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]

    def beside(c: str) -> str:
        return "letter" if c.isalpha() else "digit" if c.isdigit() else c

    left, right = before.lower().split(), after.lower().split()
    n = len(own)
    spread = -sum(own.count(c) / n * np.log2(own.count(c) / n) for c in set(own))
    named = [
        f"shape {shape}", f"kinds {re.sub('[0-9]+', '', shape)}", f"digits {sum(c.isdigit() for c in own)}", f"length {n.bit_length()}", f"spread {round(2 * spread)}",
        f"before {beside(before[-1:])}", f"after {beside(after[:1])}", f"left {left[-1] if left else ''}", f"right {right[0] if right else ''}", f"far left {left[-2] if len(left) > 1 else ''}", "always",
    ]
    named += [f"{name} says {vote}" for name, vote in zip(LABELERS[1:], votes(text, span, False)[1:], strict=True) if vote]
    return [bucket(x) for x in named]


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def odds() -> np.ndarray:
    """How much each labeler's votes (nothing, for, against) speak for personal data, before anything is counted."""
    return np.array([(1.0, 0.6 / min(0.3, a), min(0.2, b) / 0.4) for a, b in MOST_WRONG])


def first_weights() -> np.ndarray:
    """Weights of a classifier that has learned nothing yet: votes weigh as they do at the beginning of EM."""
    out = np.zeros(BUCKETS)
    for name, own in zip(LABELERS[1:], odds()[1:], strict=True):
        for vote in (1, 2):
            out[bucket(f"{name} says {vote}")] = np.log(own[vote])
    return out


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 100, most_wrong: Sequence[tuple[float, float]] | None = None) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """EM over counted vote patterns of one kind: the share of personal data, the chance of each vote of each labeler
    given the truth (labeler, truth, vote), and each pattern's chance to be personal data.

    most_wrong bounds each labeler's chance to vote for (1) what is none and against (2) what is; what is beyond goes to its other
    votes in proportion, which is the likeliest table within the bounds."""
    patterns, n = np.array(list(counts)), np.array(list(counts.values()), float)
    chance = np.clip(0.5 + 0.2 * ((patterns == 1).sum(axis=1) - 1.5 * (patterns == 2).sum(axis=1)), 0.05, 0.95)
    if most_wrong is not None:  # where to begin: votes weigh as their bounds say
        chance = 1 / (1 + 1 / odds()[np.arange(patterns.shape[1]), patterns].prod(axis=1))
    share, tables = 0.5, np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        share = float((chance @ n + 1) / (n.sum() + 2))
        for truth, weight in ((0, (1 - chance) * n), (1, chance * n)):
            for vote in range(3):
                tables[:, truth, vote] = weight @ (patterns == vote) + 0.5
        tables /= tables.sum(axis=2, keepdims=True)
        for own, bounds in zip(tables, most_wrong or (), strict=False):
            for truth, wrong, most in ((0, 1, bounds[0]), (1, 2, bounds[1])):
                if own[truth, wrong] > most:
                    own[truth] *= (1 - most) / (1 - own[truth, wrong])
                    own[truth, wrong] = most
        logs = [np.log(p) + np.log(tables[np.arange(patterns.shape[1]), truth, patterns]).sum(axis=1) for truth, p in ((0, 1 - share), (1, share))]
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return share, tables, dict(zip(counts, chance.tolist(), strict=True))


def classifier(rows: list[list[int]], chance: list[float], first: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression of soft labels on buckets of features; what the rows say nothing of stays as it was at first."""
    first = np.zeros(BUCKETS) if first is None else first
    x = np.zeros((len(rows), BUCKETS))
    for i, own in enumerate(rows):
        x[i, own] = 1.0
    y, w, speed = np.array(chance), first.copy(), np.zeros(BUCKETS)
    for _ in range(STEPS):
        slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(rows) + 1e-4 * (w - first)
        speed = 0.9 * speed - 0.5 * slope
        w = w + speed
    return w


def probability(own: list[int], weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-weights[list(set(own))].sum())))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """The span classifier of each kind of which there are candidates.

    The votes on all candidates of all texts are counted, and reliabilities estimated from these counts. The classifier
    learns from at most `sample` spans of each kind, those with the least hashes of span and surroundings.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held: list[dict[int, tuple[str, list[int]]]] = [{} for _ in KINDS]
        for batch in batches(rows):
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                for span, strict in [*((x, True) for x in base), *((x, False) for x in loose_spans(text, base))]:
                    pattern = "".join(map(str, votes(text, span, strict)))
                    seen[span[1], pattern] += 1
                    mark = xxhash.xxh64_intdigest(text[max(0, span[0] - AROUND) : span[2] + AROUND].encode("utf-8", "replace")) >> 1
                    held[span[1]].setdefault(mark, (pattern, features(text, span)))
            for kind, own in enumerate(held):
                if len(own) > 2 * sample:
                    held[kind] = {mark: own[mark] for mark in sorted(own)[:sample]}
        keys = list(seen)
        yield out_batch(SEEN, [[k for k, _ in keys], [p for _, p in keys], [seen[k] for k in keys], [None] * len(keys), [None] * len(keys)])
        for kind, own in enumerate(held):
            marks = sorted(own)[:sample]
            yield out_batch(SEEN, [[kind] * len(marks), [own[m][0] for m in marks], [0] * len(marks), marks, [own[m][1] for m in marks]])

    seen = written(docs.select(valid_text()).mapInArrow(run, SEEN), "candidates")
    table: dict[int, dict[tuple[int, ...], int]] = {}
    for r in seen.where("hash is null").groupBy("kind", "pattern").agg(F.sum("n").alias("n")).collect():  # at most kinds x 3 ** labelers rows
        table.setdefault(r["kind"], {})[tuple(map(int, r["pattern"]))] = r["n"]
    chances = {kind: reliabilities(counts, most_wrong=MOST_WRONG)[2] for kind, counts in table.items()}
    out = {}
    for kind, chance in chances.items():
        chosen = seen.where((F.col("kind") == kind) & F.col("hash").isNotNull()).groupBy("hash").agg(F.min(F.struct("pattern", "features")).alias("own"))
        rows = chosen.orderBy("hash").limit(sample).collect()
        out[kind] = classifier([r["own"]["features"] for r in rows], [chance[tuple(map(int, r["own"]["pattern"]))] for r in rows], first_weights())
    return out


def find(docs: DataFrame, weights: dict[int, np.ndarray], least: float = 0.9) -> DataFrame:
    """doc_id, counts of base spans by kind, and base and all spans as kind:start:end lists."""

    def listed(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                more = loose_spans(text, base) if text else []
                more = [s for s in more if s[1] in weights and probability(features(text, s), weights[s[1]]) >= least]
                n = Counter(kind for _, kind, _ in base)
                out.append((n[0], n[1], n[2], n[3], listed(base), listed(sorted(base + more)) if more else listed(base)))
            yield out_batch(FOUND, [batch.column(0), *(list(c) for c in zip(*out, strict=True))])

    return docs.select(F.col("doc_id").cast("long"), valid_text()).mapInArrow(run, FOUND)
