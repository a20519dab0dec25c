"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how far each
labeler can be trusted, and a span classifier trained on the resulting probabilities decides.

Two passes over the texts. The first counts candidates by votes and by features of the span and its context (length,
separators, the characters around it, other candidates nearby, place in the line), all in a bounded number of values
whatever the corpus. From the votes the driver estimates reliabilities and probabilities; on these the classifier is
trained, which sees the features as well and so tells apart what the labelers cannot. The second pass finds the spans
again and keeps the accepted ones; nothing about single documents is shuffled or collected. Spans that the base rules
find are always kept.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")

# Patterns of the base rules, of looser shapes, gazetteers and context words.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at |@) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,24}(?![A-Za-z])")
LOOSE_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
FOUR = re.compile("[0-9]{4}")
DOTS = (" dot ", "(dot)", "[dot]")
TOP_DOMAINS = frozenset("com net org edu gov info biz io de fr es it uk nl eu us".split())
CALLING_CODES = ("1", "33", "34", "39", "44", "49")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "60", "65", "35")
CONTEXT = {
    "email": frozenset("mail email e-mail contact write kontakt correo courriel".split()),
    "ip": frozenset("ip address server host adresse addr".split()),
    "card": frozenset("card visa mastercard payment karte carte tarjeta credit".split()),
    "phone": frozenset("tel phone call fax mobile telefon telefono handy whatsapp".split()),
}
AGAINST = frozenset("version token isbn serial figure order invoice build ref".split())
WORDS = re.compile(r"[^\W\d_][\w-]*")

#: A vote in {-1, 0, 1} from each labeler, and values of each feature of a span and its context.
LABELERS = ("pattern", "gazetteer", "context", "digits", "edges")
FEATURES = {"length": 5, "left": 4, "right": 4, "separators": 3, "nearby": 3, "line": 2}
SHAPES = 5 * 4 * 4 * 3 * 3 * 2
#: Characters within which another candidate is nearby.
NEARBY = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Each '@' with the run of local characters before it and a domain behind it. A match fails or holds for its '@'
    alone, so one step per '@' gives what leftmost non-overlapping matching gives, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            a = at
            while a > end and text[a - 1] in LOCAL:
                a -= 1
            if a < at:
                yield a, m.end()
                end = m.end()
        at = text.find("@", max(at + 1, end))


def _spans(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, end, kind, base, strict vote): base spans, shapes that failed a base check, and looser shapes."""
    out = []
    if "@" in text:
        out += [(a, b, 0, True, 1) for a, b in _emails(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                good = luhn(digits)
                out.append((m.start(), m.end(), 2, good, 1 if good else -1))
    if "." in text:
        for m in IP.finditer(text):
            good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))
            out.append((m.start(), m.end(), 1, good, 1 if good else -1))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(48 <= ord(c) <= 57 for c in m.group())
            good = 9 <= n <= 15
            out.append((m.start(), m.end(), 3, good, 1 if good else -1))
    loose = []
    if any(d in text for d in DOTS):
        loose += [(m.start(), m.end(), 0, False, 0) for m in LOOSE_MAIL.finditer(text)]
    if FOUR.search(text):
        loose += [(m.start(), m.end(), 3, False, 0) for m in LOOSE_PHONE.finditer(text)]
    if loose:
        taken = sorted((a, b) for a, b, *_ in out)
        starts = [a for a, _ in taken]
        reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for c in sorted(loose):
            k = int(np.searchsorted(starts, c[1])) - 1  # the last span that begins before the candidate ends
            if k < 0 or reach[k] <= c[0]:
                out.append(c)
    return out


def _votes(text: str, a: int, b: int, kind: int, strict: int) -> tuple[int, ...]:
    s = text[a:b]
    digits = [c for c in s if "0" <= c <= "9"]
    if kind == 0:
        known = s.rpartition(".")[2].lower() in TOP_DOMAINS or s.rpartition(" ")[2].lower() in TOP_DOMAINS
        gazetteer = 1 if known else -1
    elif kind == 1:
        first = s.split(".")[0].lstrip("0")
        gazetteer = 1 if first and len(first) <= 3 and int(first) < 224 and int(first) != 127 else -1
    elif kind == 2:
        gazetteer = 1 if "".join(digits[:2]).startswith(ISSUERS) else 0
    else:
        gazetteer = 1 if s[:1] != "+" or "".join(digits[:2]).startswith(CALLING_CODES) else 0
    near = {w.lower() for w in WORDS.findall(text[max(0, a - 32) : a])} | {w.lower() for w in WORDS.findall(text[b : b + 12])}
    context = 1 if near & CONTEXT[KINDS[kind]] else -1 if near & AGAINST else 0
    variety = 0 if kind == 0 else 1 if len(set(digits)) >= 3 else -1
    left, right = text[a - 1 : a], text[b : b + 1]
    edges = -1 if (left.isalnum() and kind != 0) or right.isalnum() else 1
    return strict, gazetteer, context, variety, edges


def _sort_of(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def _shape(text: str, a: int, b: int, nearby: int) -> int:
    """The features of a span as one number."""
    kinds = len({c for c in text[a:b] if c in " -.()"})
    values = (sum(b - a > n for n in (8, 12, 16, 24)), _sort_of(text[a - 1 : a]), _sort_of(text[b : b + 1]), min(kinds, 2), nearby, int(not a or text[a - 1] == "\n"))
    code = 0
    for n, v in zip(FEATURES.values(), values):
        code = code * n + v
    return code


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    """(start, end, kind, base, votes and features) of a whole text; null is empty. Code points, end exclusive."""
    if not text:
        return []
    spans = sorted(_spans(text))
    out = []
    for i, (a, b, kind, base, strict) in enumerate(spans):
        around = [s[2] for s in spans[max(i - 1, 0) : i] if a - s[1] <= NEARBY] + [s[2] for s in spans[i + 1 : i + 2] if s[0] - b <= NEARBY]
        nearby = 0 if not around else 1 if kind in around else 2
        out.append((a, b, kind, base, _coded(kind, _votes(text, a, b, kind, strict)) * SHAPES + _shape(text, a, b, nearby)))
    return out


def _coded(kind: int, votes: tuple[int, ...]) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code


def _decoded(code: int) -> tuple[int, list[int]]:
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1]


def counted(docs: DataFrame) -> dict[int, int]:
    """Candidates by votes and features, over all documents: at most 4 * 3^5 * SHAPES counts."""

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                n.update(c[4] for c in candidates(text.as_py()))
        if n:
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(n, pa.int64()), "n": pa.array(n.values(), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}


def reliabilities(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Expectation-maximisation over labelers that err independently given the truth: the probability of each pattern
    to be personal data, and P(vote | truth) as an array [labeler, truth, vote]. Starts from the majority of votes;
    one count is added to each cell, so that unseen votes keep some probability."""
    if not counts:
        return {}, np.full((len(LABELERS), 2, 3), 1 / 3)
    codes = sorted(counts)
    kinds, votes = zip(*(_decoded(c) for c in codes))
    kind, v, n = np.array(kinds), np.array(votes) + 1, np.array([counts[c] for c in codes], float)
    q = 1 / (1 + np.exp(-(v - 1).sum(1)))
    table = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        w = np.stack([n * (1 - q), n * q])
        prior = np.array([(w[1][kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        for j in range(len(LABELERS)):
            for y in (0, 1):
                table[j, y] = np.bincount(v[:, j], w[y], 3) + 1
        table /= table.sum(2, keepdims=True)
        odds = np.log(prior / (1 - prior))[kind] + sum(np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]]) for j in range(len(LABELERS)))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes, q.tolist())), table


def _inputs(code: int) -> np.ndarray:
    """What the classifier sees of a candidate: its kind, its votes, and its features by kind, as ones among zeros."""
    votes_code, shape = divmod(code, SHAPES)
    kind, votes = _decoded(votes_code)
    x = np.zeros(len(KINDS) + 2 * len(LABELERS) + len(KINDS) * sum(FEATURES.values()))
    x[kind] = 1
    for j, v in enumerate(votes):
        if v:
            x[len(KINDS) + 2 * j + (v > 0)] = 1
    at = len(x) - (kind + 1) * sum(FEATURES.values())
    for n in reversed(FEATURES.values()):
        shape, v = divmod(shape, n)
        x[at + v] = 1
        at += n
    return x


def trained(counts: dict[int, int], probability: dict[int, float], rounds: int = 30, ridge: float = 1.0):
    """A logistic classifier of spans, fitted by Newton steps to the probabilities (of the votes' patterns); returns its
    score function of votes and features. No counts: all scores are one half."""
    w = np.zeros(len(_inputs(0)))
    if counts:
        codes = sorted(counts)
        x, n, y = np.array([_inputs(c) for c in codes]), np.array([counts[c] for c in codes], float), np.array([probability[c // SHAPES] for c in codes])
        n /= max(n.sum() / 1e4, 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (p - y)) + ridge * w
            h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w -= np.linalg.solve(h, g)
    return lambda code: float(1 / (1 + np.exp(-np.clip(_inputs(code) @ w, -30, 30))))


def fitted(docs: DataFrame, least: float = 0.75) -> frozenset[int]:
    """The votes and features in docs whose spans the trained classifier takes for personal data with a probability of
    least."""
    counts = counted(docs)
    votes: Counter = Counter()
    for code, n in counts.items():
        votes[code // SHAPES] += n
    score = trained(counts, reliabilities(votes)[0])
    return frozenset(c for c in counts if score(c) >= least)


def kept(text: str | None, accepted: frozenset[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, as (start, kind, end) in order."""
    found = candidates(text)
    return sorted((a, k, b) for a, b, k, base, _ in found if base), sorted((a, k, b) for a, b, k, base, code in found if base or code in accepted)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found(spark: SparkSession, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, spans array<struct<kind, start, end, text, base>>, and counts and digests of them.

    n_email, n_ip, n_card, n_phone count base spans, n_added the others. One row per row of docs; null and empty texts
    have no spans (spans is then an empty string); an empty table gives an empty one; other columns are left out.
    """
    small_batches(spark)
    accepted = fitted(docs)
    kind_of = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans", "found")}
            for text in b.column(1):
                text = text.as_py() or ""
                base, spans = kept(text, accepted)
                n = [0] * len(KINDS)
                for _, k, _ in base:
                    n[k] += 1
                for name, v in zip(out, (*n, len(spans) - len(base), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [{"kind": KINDS[k], "start": a, "end": e, "text": text[a:e]} for a, k, e in spans])):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(out[k], pa.int64()) for k in list(out)[:5]), pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["found"], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])))],
                [key, *out],
            )

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind_of}, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long, text: string>>")


def masked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, and n_chars (if there) made to fit. Overlapping
    spans become one, named after the first. Null texts stay null; all columns stay."""
    small_batches(spark)
    accepted = fitted(docs)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def hide(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        last = None
        for a, k, e in kept(text, accepted)[1]:
            if last is not None and a < end:
                end = max(end, e)
                continue
            out += [text[end:a], f"[{KINDS[k].upper()}]"]
            last, end = k, e
        return "".join(out) + text[end:] if out else text

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            texts = [hide(t.as_py()) for t in cols[at]]
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
