"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

A fixed base (four patterns) is always reported.  A wider net collects candidate
spans of the same kinds (spelled-out addresses, numbers without a leading plus,
unusual separators).  Regex, gazetteer and context labelers vote on every candidate;
expectation-maximisation over the vote patterns of the whole corpus estimates how
far each labeler can be trusted, per kind (Dawid and Skene, 1979); its posteriors
train a logistic span classifier, whose accepted spans join the base.

The corpus pass leaves one light row for each document; EM and the classifier see
only counts of distinct vote patterns, of which there are at most
4 * 3 ** LABELERS * 2 ** FEATURES, however large the corpus.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
#: The wider net, by kind.  Local parts and labels have the lengths that mail and domain names may have (64 and 63).
WIDE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({]dot[\])}]| dot ) ?[A-Za-z0-9-]{1,63})+(?![A-Za-z0-9])", re.I)),
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: at | ?@ )[A-Za-z0-9-]{1,63}(?: dot [A-Za-z0-9-]{1,63})+(?![A-Za-z0-9])", re.I)),
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?@ ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+(?![A-Za-z0-9])")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]| dot )[0-9]{1,3}){3}(?![0-9])", re.I)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[./_ ]{1,2}[0-9]{4}){2}[./_ ]{1,2}[0-9]{2,7}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")),
    (3, re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:00[ .-]?[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-][0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9.-]?[0-9])")),
)
#: What tells that a text may hold something of the wider net: each of its patterns needs one of these.
HINT = re.compile(r"[0-9]{14}|[0-9](?:[ ./()_ \[-]{1,2}[(]?|\[\.\]|\(\.\)|\[dot\]| dot )[0-9]|[\[({]at[\])}]| at [A-Za-z0-9-]{1,63} dot |@|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:", re.I)
#: Gazetteers.
TLDS = frozenset("com org net edu gov int info biz io de fr es it uk us eu ch at be nl pl pt se no dk fi ie ca au nz jp cn kr in br mx ru".split())
WORDS = (
    frozenset("email e-mail mail contact write courriel correo adresse mailto reply".split()),
    frozenset("ip host server address addr adresse direccion ping gateway node from".split()),
    frozenset("card visa mastercard amex credit debit karte carte tarjeta iban payment".split()),
    frozenset("phone tel telephone call mobile cell fax telefon telefono whatsapp sms dial".split()),
)
AGAINST = frozenset("version isbn issn order invoice page pages vol volume section chapter fig figure table date year price total sum id sku ref no nr".split())
BEFORE = re.compile(r"[^\W\d_][\w-]*", re.UNICODE)
LABELERS, FEATURES = 7, 5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The base matches as (start, kind, end), leftmost and non-overlapping within a kind; failing ones dropped.

    Emails are found from their at-signs outwards, so a long run without one costs nothing.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:] if len(x) > 4 else x) <= 255 for x in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _votes(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """Votes (0 none, 1 against, 2 for; base 3) and features (bits) of a span, as one number."""
    span = text[start:end]
    digits = "".join(DIGITS.findall(span))
    before = [w.lower() for w in BEFORE.findall(text[max(0, start - 40) : start])[-3:]]
    after = text[end : end + 1]
    lead = text[start - 1 : start]
    letters = sum(c.isalpha() for c in span)
    if kind == 0:
        parts = [p for p in re.split(r"[^A-Za-z0-9]+", span.lower()) if p]
        shape = 2 if len(parts) >= 3 else 1
        known = 2 if parts and parts[-1] in TLDS else 1
        marked = 2 if re.search(r"@|[\[({]at[\])}]", span, re.I) else 1
    elif kind == 1:
        parts = DIGITS.findall(span)
        v6 = ":" in span
        shape = 2 if v6 or all(int(p) <= 255 for p in parts) else 1
        known = 2 if (v6 and letters) or len(set(parts)) > 1 else 1
        marked = 0 if base else (2 if re.search(r"[\[(]", span) or span.count(":") >= 5 else 1)
    elif kind == 2:
        shape = 2 if 14 <= len(digits) <= 19 and _luhn(digits) else 1
        known = 2 if digits[:1] in ("3", "4", "5", "6") else 1
        marked = 2 if len(set(re.findall(r"[^0-9]", span))) <= 1 else 1
    else:
        shape = 2 if 9 <= len(digits) <= 15 else 1
        known = 2 if span[:1] == "+" or span[:2] == "00" else 0
        marked = 2 if re.search(r"\([0-9]+\)|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^[+]", span) else 1
    votes = [
        2 if base else 0,
        shape,
        known,
        marked,
        2 if any(w in WORDS[kind] for w in before) else 0,
        1 if any(w in AGAINST for w in before) else 0,
        1 if len(set(digits)) == 1 or lead.isalpha() or after.isalpha() else 2,
    ]
    features = [len(digits) >= 10, "@" in span, bool(re.search(r"dot|at", span, re.I)), " " in span, "\n" in span]
    code = 0
    for v in votes:
        code = code * 3 + v
    for f in features:
        code = code * 2 + f
    return code


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the wider net that overlap no base span and no earlier candidate of their kind."""
    if not HINT.search(text):
        return []
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    reach, top = [], 0
    for _, e in taken:
        top = max(top, e)
        reach.append(top)
    own: list[list[tuple[int, int]]] = [[] for _ in KINDS]  # what a kind has, in order
    for kind, pattern in WIDE:
        has = own[kind]
        begins, new = [s for s, _ in has], []
        for m in pattern.finditer(text):  # a pattern's matches do not overlap each other
            s, e = m.span()
            at, i = bisect_left(starts, e), bisect_left(begins, e)
            if not (at and reach[at - 1] > s) and not (i and has[i - 1][1] > s):
                new.append((s, e))
        if new:
            own[kind] = sorted(has + new)
    return sorted((s, kind, e) for kind, has in enumerate(own) for s, e in has)


def accepted(base: list[tuple[int, int, int]], ranked: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base, and of the ranked spans, in order, each that overlaps nothing taken before."""
    taken = bytearray(max([e for _, _, e in base] + [e for _, _, e in ranked], default=0))
    out = list(base)
    for s, _, e in base:
        taken[s:e] = b"\1" * (e - s)
    for s, k, e in ranked:
        if taken.find(1, s, e) < 0:
            taken[s:e] = b"\1" * (e - s)
            out.append((s, k, e))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, kinds, starts, ends, base, codes): the spans of each row, in order."""
    schema = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, base array<boolean>, codes array<long>"

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = [(s, k, e, True) for s, k, e in base] + [(s, k, e, False) for s, k, e in candidate_spans(text, base)]
                spans.sort()
                cols[0].append([k for _, k, _, _ in spans])
                cols[1].append([s for s, _, _, _ in spans])
                cols[2].append([e for _, _, e, _ in spans])
                cols[3].append([b for _, _, _, b in spans])
                cols[4].append([_votes(text, k, s, e, b) for s, k, e, b in spans])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(t)) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "kinds", "starts", "ends", "base", "codes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (n x LABELERS) and features (n x FEATURES) of the codes."""
    features = np.stack([(codes >> (FEATURES - 1 - i)) & 1 for i in range(FEATURES)], axis=1)
    rest = codes >> FEATURES
    votes = np.stack([(rest // 3 ** (LABELERS - 1 - i)) % 3 for i in range(LABELERS)], axis=1)
    return votes, features


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of each pattern, and P(vote | class) for each labeler.

    It starts from labelers that are right four times out of five when they vote;
    pseudo-counts keep a labeler that never votes from deciding anything.
    """
    prior = 0.5
    start = np.array([[0.34, 0.53, 0.13], [0.34, 0.13, 0.53]])  # [class][none, against, for]
    table = np.repeat(start[None], votes.shape[1], axis=0)
    post = np.full(len(counts), 0.5)
    for _ in range(rounds):
        logs = np.log(table)
        score = np.zeros((len(counts), 2))
        for j in range(votes.shape[1]):
            score += logs[j][:, votes[:, j]].T
        score += np.log([1 - prior, prior])
        score -= score.max(axis=1, keepdims=True)
        both = np.exp(score)
        post = both[:, 1] / both.sum(axis=1)
        prior = float(np.clip((post @ counts + 5) / (counts.sum() + 10), 0.02, 0.98))
        for j in range(votes.shape[1]):
            for c, weight in enumerate(((1 - post) * counts, post * counts)):
                table[j, c] = np.bincount(votes[:, j], weights=weight, minlength=3) + 20 * start[c]
                table[j, c] /= table[j, c].sum()
    return post, table


def _design(votes: np.ndarray, features: np.ndarray) -> np.ndarray:
    return np.concatenate([votes == 1, votes == 2, features == 1, np.ones((len(votes), 1), bool)], axis=1).astype(float)


def train(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(scanned: DataFrame) -> dict[int, np.ndarray]:
    """The span classifier of each kind, from counts of the vote patterns of all documents."""
    rows = scanned.select(F.explode(F.arrays_zip("kinds", "codes")).alias("x")).groupBy("x.kinds", "x.codes").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for kind in range(len(KINDS)):
        own = sorted((r["codes"], r["n"]) for r in rows if r["kinds"] == kind)
        if own:
            codes, counts = np.array([c for c, _ in own]), np.array([n for _, n in own], dtype=float)
            votes, features = decode(codes)
            post, _ = estimate(votes, counts)
            out[kind] = train(_design(votes, features), post, counts)
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_spans), a row for each row.

    The counts and ``base_spans`` are the base's; ``spans`` adds candidates that the
    classifier gives ``threshold`` or more and that overlap nothing taken before
    (the likelier first, of equally likely ones the earlier, then by kind); ``n_spans`` counts
    them all.  Positions are code points, the end exclusive.  A null or empty text has no
    spans; repeated rows each get their own; texts are searched whole, in time that grows
    with their length and spans alone; an empty table gives an empty one; other columns are ignored.
    """
    scanned = cut(scan(docs))
    models = fit(scanned)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_spans long"

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for kinds, starts, ends, base, codes in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                kept = [(s, k, e) for k, s, e, b in zip(kinds, starts, ends, base, strict=True) if b]
                for k in range(4):
                    out[k].append(sum(x[1] == k for x in kept))
                out[4].append(_join(kept))
                rest = [(k, s, e, c) for k, s, e, b, c in zip(kinds, starts, ends, base, codes, strict=True) if not b and k in models]
                if rest:
                    votes, features = decode(np.array([r[3] for r in rest]))
                    x = _design(votes, features)
                    odds = (x * np.stack([models[r[0]] for r in rest])).sum(axis=1)
                    likely = sorted((-z, s, k, e) for z, (k, s, e, _) in zip(odds.tolist(), rest, strict=True) if 1 / (1 + np.exp(-z)) >= threshold)
                    kept = accepted(kept, [(s, k, e) for _, s, k, e in likely])
                out[5].append(_join(kept))
                out[6].append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:6]), pa.array(out[6], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_spans"])

    return scanned.mapInArrow(run, schema)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
