"""Personal data by weak-supervision aggregation.

Every span that a loose pattern proposes is voted on by labelers: the strict pattern, its checksum, gazetteers, the
context before it, its neighbours and its length. The votes of all documents are counted by pattern, expectation-
maximisation estimates how reliable each labeler is for each kind, and the posteriors train a logistic classifier over
the votes and shapes, which decides on the spans that the strict patterns don't already give. Those always stay.

Proposed beyond the strict patterns are: addresses with (at) and (dot) or without a domain, any four numbers with dots, any
seven digits and more with the usual separators (phone numbers without a country, cards that fail their checksum), and, as
a kind of its own, `secret`: unbroken runs of 16 characters and more in which letters and digits mix (keys, tokens,
passwords).

Inputs: null and empty texts have no spans; repeated rows are scanned each; an empty table, or one without candidates,
gives the strict spans only; only the key and the text column are read, so further columns never clash. Long texts are
handled whole, in time linear in their length. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: The kinds with strict patterns, and all.
KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
LABELERS = ("strict", "checksum", "gazetteer", "context", "neighbours", "length")
#: What is held of labelers before any vote is seen, as counts of votes (against, none, for) where a span is not and where it is of the kind:
#: a checksum that fails says most, neighbours and length say little. It decides where there are hardly any candidates, and fades with their number.
HELD = {
    "strict": ((1, 3, 0.2), (1, 1, 2)), "checksum": ((4, 1, 0.5), (0.1, 1, 2)), "gazetteer": ((2, 1, 0.5), (0.5, 1, 2)),
    "context": ((2, 2, 0.3), (0.15, 0.7, 2)), "neighbours": ((2, 1, 1.2), (0.3, 1, 2)), "length": ((2, 1, 1.2), (0.3, 1, 2)),
}
#: Rounds of expectation-maximisation, steps of the classifier, the probability from which a span is taken.
ROUNDS, STEPS, TAKEN = 50, 300, 0.5

# The strict patterns: fixed values of the contract. A run of digits is entered at its start only, which changes no match.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Loose proposals.
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]\x20?(?:at|AT)\x20?[)\]]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]\x20?(?:dot|DOT)\x20?[)\]]\x20?)[A-Za-z0-9-]{1,63})+")
NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
SECRET = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}")
DIGIT = re.compile("[0-9]")
MIXED = re.compile("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")
# Gazetteers: ends of host names, first digits of card numbers, openings of keys, and words that announce a kind.
ENDINGS = frozenset("com org net edu gov info io eu de fr es it uk us ch at nl".split())
ISSUERS = re.compile("4|5[1-5]|3[47]|6011|65|35|2[2-7]")
ISSUED = re.compile("AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xox[abp]-|eyJ|AIza|glpat-")
TRIGGERS = {
    "secret": frozenset("token secret password passwd pwd key api apikey api_key access_key secret_key auth bearer credential credentials passwort clave contraseña".split()),
    "email": frozenset("mail email e-mail contact write correo courriel".split()),
    "ip": frozenset("ip address host server login from".split()),
    "card": frozenset("card visa mastercard amex credit debit iban account karte carte tarjeta".split()),
    "phone": frozenset("call phone tel telephone mobile fax telefon teléfono".split()),
}
AGAINST = frozenset("version v release section page isbn token key hash sha id commit no. order invoice".split())
#: Words that speak against a secret: what is public by what it is.
PUBLIC = frozenset("sha md5 hash commit checksum digest isbn uuid id http https www version file path".split())


def strict_emails(text: str) -> list[tuple[int, int]]:
    """From each @: its local part reaches back over all characters it may hold, but not into the match before."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        # What stands between this @ and the next one can belong to no other match's start.
        at = text.find("@", max(at + 1, end))
        end = max(end, text.rfind("@", 0, at) + 1) if at >= 0 else end
    return found


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def in_range(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


def strict(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = strict_emails(text)
    if DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in IP.finditer(text) if all(map(in_range, m[0].split(".")))]
        found["card"] = [m.span() for m in CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def proposals(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, strict), strict ones first; the loose ones overlap none of these and none before them."""
    out = [(k, a, b, True) for k in KINDS for a, b in base[k]]
    loose = []
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            start = at
            while start and at - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := HOST.match(text, at + 1, at + 256)):
                loose.append(("email", start, m.end(), False))
            at = text.find("@", at + 1)
    if "(" in text or "[" in text:
        loose += [("email", *m.span(), False) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            loose.append(("ip", *m.span(), False))
        for m in NUMBER.finditer(text):
            n = len(digits_of(m[0]))
            if n <= 19:
                loose.append(("card" if n >= 13 else "phone", *m.span(), False))
        if max(map(len, text.split()), default=0) >= 16:
            loose += [("secret", *m.span(), False) for m in SECRET.finditer(text) if DIGIT.search(m[0]) and not m[0].replace("-", "").isdigit() and any(c.isalpha() for c in m[0])]
    if loose:
        held = sorted((a, b) for _, a, b, _ in out)
        end, k = 0, 0
        for kind, a, b, _ in sorted(loose, key=lambda x: (x[1], -x[2])):
            while k < len(held) and held[k][1] <= a:
                k += 1
            if a >= end and (k == len(held) or held[k][0] >= b):
                out.append((kind, a, b, False))
                end = b
    return out


def votes(text: str, kind: str, a: int, b: int, is_strict: bool) -> str:
    """One letter for each labeler (+ for, - against, 0 none), then the shape: digits and separators, in classes."""
    span = text[a:b]
    digits = digits_of(span)
    n = len(digits)
    checksum = gazetteer = length = "0"
    if kind == "card":
        checksum = "+" if luhn(digits) else "-"
        gazetteer = "+" if ISSUERS.match(digits) else "0"
        length = "+" if n in (15, 16) else "-"
    elif kind == "ip":
        checksum = "+" if all(map(in_range, span.split("."))) else "-"
        length = "+" if max(map(len, span.split("."))) <= 3 else "-"
        gazetteer = "-" if digits[:1] == "0" else "0"
    elif kind == "email":
        gazetteer = "+" if re.split(r"[^a-z]+", span.lower().rstrip("-.)]"))[-1] in ENDINGS else "-"
        length = "+" if len(span) <= 80 else "-"
    elif kind == "secret":
        # Characters in no order: capitals, small letters and digits change places all along, as they do not in words and names.
        checksum = "+" if 5 * len(MIXED.findall(span)) >= len(span) else "-"
        gazetteer = "+" if ISSUED.match(span) else "0"
        length = "+" if 20 <= len(span) <= 128 else "-"
    else:
        gazetteer = "+" if span[0] == "+" else "0"
        length = "+" if 9 <= n <= 13 else "-"
        checksum = "+" if "(" in span and ")" in span else "0"
    before = re.split(r"[\s:=,;\"']+", text[max(0, a - 40) : a].lower())
    context = "+" if TRIGGERS[kind].intersection(before) else "-" if (PUBLIC if kind == "secret" else AGAINST).intersection(before) else "0"
    near = text[a - 1 : a] + text[b : b + 1] if a else text[b : b + 1]
    if kind == "secret":  # quoted or assigned
        neighbours = "+" if any(c in "\"'`:=" for c in near) else "-" if any(c.isalnum() or c in "./@&?" for c in near) else "0"
    else:
        neighbours = "-" if any(c.isalnum() or c in "_/=" for c in near) else "+"
    shape = f"{min(n, 20):02d}{'s' if ' ' in span else '-'}{'p' if '(' in span else '-'}{'d' if '.' in span else '-'}"
    return f"{kind}|{'+' if is_strict else '0'}{checksum}{gazetteer}{context}{neighbours}{length}|{shape}"


@dataclass
class Model:
    """How reliable the labelers are, and the classifier's weights; decides by a pattern of votes and shape."""

    priors: dict[str, float] = field(default_factory=dict)
    reliabilities: dict[str, np.ndarray] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    accepted: dict[str, float] = field(default_factory=dict)

    def takes(self, pattern: str) -> bool:
        score = self.accepted.get(pattern)
        if score is None:
            score = self.accepted[pattern] = 1 / (1 + np.exp(-sum(self.weights.get(f, 0.0) for f in features(pattern))))
        return score >= TAKEN


def features(pattern: str) -> list[str]:
    kind, vote, shape = pattern.split("|")
    return [kind, *(f"{kind}.{name}{v}" for name, v in zip(LABELERS[1:], vote[1:], strict=True)), f"{kind}.n{shape[:2]}", f"{kind}.{shape[2:]}"]


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict[str, float], dict[str, np.ndarray]]:
    """Posterior of each pattern, priors, and P(vote | truth) by kind as [labeler, truth, vote], starting from what is held of the labelers."""
    posterior, priors, reliabilities = np.zeros(len(patterns)), {}, {}
    for kind in EVERY:
        rows = [i for i, p in enumerate(patterns) if p.startswith(kind + "|")]
        if not rows:
            continue
        cast = np.array([["-0+".index(v) for v in patterns[i].split("|")[1]] for i in rows])
        weight = counts[rows].astype(float)
        q = None
        for _ in range(rounds):
            given = np.array([HELD[name] for name in LABELERS], dtype=float)
            prior = 0.5
            if q is not None:
                prior = ((weight * q).sum() + 1) / (weight.sum() + 2)
                for truth, share in enumerate((1 - q, q)):
                    for labeler in range(len(LABELERS)):
                        given[labeler, truth] += np.bincount(cast[:, labeler], weights=weight * share, minlength=3)
            given /= given.sum(axis=2, keepdims=True)
            said = np.log(given)[np.arange(len(LABELERS))[None, :], :, cast].sum(axis=1)
            q = 1 / (1 + np.exp(np.clip(said[:, 0] - said[:, 1] + np.log((1 - prior) / prior), -50, 50)))
            # A strict span is what the kind means: that much is known.
            q = np.where(cast[:, 0] == 2, np.maximum(q, 0.99), q)
        posterior[rows], priors[kind], reliabilities[kind] = q, float(prior), given
    return posterior, priors, reliabilities


def fit(counted: dict[str, int], steps: int = STEPS) -> Model:
    """From the number of candidates of each pattern of votes and shape."""
    patterns = sorted(counted)
    if not patterns:
        return Model()
    counts = np.array([counted[p] for p in patterns], dtype=float)
    q, priors, reliabilities = expectation_maximisation(patterns, counts)
    names = sorted({f for p in patterns for f in features(p)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for i, p in enumerate(patterns):
        x[i, [place[f] for f in features(p)]] = 1
    weight = counts / counts.sum()
    w, seen = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(steps):
        gradient = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - q)) + 1e-5 * w
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
    return Model(priors, reliabilities, dict(zip(names, w.tolist(), strict=True)))


def pattern_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """The number of candidates by pattern, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in common.slices(batch, "text"):
                for t in part.column(0).to_pylist():
                    if t:
                        counts.update(votes(t, *c) for c in proposals(t, strict(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "pattern string, n long")
    return {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}


def spans_of(text: str | None, model: Model) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The strict spans by kind, and all spans in the order of kinds and places."""
    if not text:
        return {k: [] for k in KINDS}, []
    base = strict(text)
    found = [(k, a, b) for k, a, b, own in proposals(text, base) if own or model.takes(votes(text, k, a, b, own))]
    return base, sorted(found, key=lambda s: (EVERY.index(s[0]), s[1], s[2]))


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the union is replaced once."""
    if text is None:
        return None
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += (text[end:a], f"<{kind.upper()}>")
        end = max(end, b)
    return "".join(out) + text[end:]


def detect(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, clean) of each row; with `whole`, `row` instead of doc_id.

    The counts and `base` (kind:start:end, with commas) are of the strict spans; `spans` has all; `clean` is the text with them replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(pattern_counts(docs, text)))

    def work():
        own = shared.value

        def each(texts: list[str | None]) -> list[list]:
            out: list[list] = [[] for _ in range(7)]
            for t in texts:
                base, spans = spans_of(t, own)
                row = [*(len(base[k]) for k in KINDS), said([(k, a, b) for k in KINDS for a, b in base[k]]), said(spans), redacted(t, spans)]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return each

    return common.annotate(docs, text, key, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, clean string", work, whole)
