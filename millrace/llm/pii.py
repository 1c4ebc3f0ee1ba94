"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (e-mail, IP, card, phone) follow fixed patterns and always stand. Further candidates
come from wide patterns. Three families of labelers vote on each candidate, for, against or not
at all: format patterns, gazetteers, and the words around it. Every kind has its own: key names
and prefixes for secrets, first digits of area codes (neither 0 nor 1) for phones, top-level domains for addresses, numbers never
issued for national ids, country lengths for IBANs. Expectation-maximisation over the
corpus-wide counts of vote patterns, kind by kind, estimates each labeler's rates of votes in
both classes, and so each pattern's posterior; a logistic span classifier on kind, votes and
shape is trained with these posteriors and gives the verdicts.

Scale: one pass over the text. Only counts by (kind, votes, shape), whose number is bounded by
the labelers and shape classes, reach the driver. All patterns take time linear in the text:
runs are entered at their start only, and repeats that are not possessive runs are bounded.

Defined results: a null text is empty; repeated rows are scanned one by one; an empty table, or
one without candidates, gives base spans alone; other columns are left out of the result.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "national_id", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A secret whose run goes on into a span found before ends there, if so much is left.
LEAST_LEFT = 20

#: Wide patterns for candidates, by kind; group 1 is the span.
_WIDE = (
    ("secret", re.compile(r"(?i)(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\x20\"']{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{6,}+)")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])([A-Z]{4}[0-9A-Z]{16}|[a-z]{2,4}[_-][A-Za-z0-9]{20,}+)(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])([0-9a-f]{16,}+)(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9.+-])(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{1,63}){1,4})")),
    ("national_id", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    # any other token with a digit: mostly no secret, and what EM needs to tell the classes apart
    ("secret", re.compile(r"(?<![0-9A-Za-z_-])((?=[A-Za-z_-]*+[0-9])[0-9A-Za-z._/-]++)")),
)

#: Key names and key prefixes of the gazetteer (fixed values).
_KEY_NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "bearer")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "pk-", "xoxb", "xoxp", "eyJ")
#: Words that speak for a kind just before a span, and words that speak against any (fixed values).
_FOR = {
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "login", "credential"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "national_id": ("ssn", "social", "security", "id"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
}
_AGAINST = ("version", "licensed", "license", "commit", "sha1", "sha256", "md5", "checksum", "hash", "isbn", "rev", "revision")
#: Top-level domains of the e-mail gazetteer (fixed values).
_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es uk it nl ch at be pt pl se no dk fi us ca au nz jp cn in br mx eu".split())
#: National ids that were printed in adverts and leaflets (fixed values).
_PUBLIC_IDS = frozenset(["078-05-1120", "219-09-9999", "123-45-6789", "111-11-1111", "457-55-5462", "555-55-5555"])
#: Lengths of IBANs by country (fixed values).
_IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
LABELERS = ("format", "gazetteer", "context_for", "context_against", "texture")


def luhn(digits: str) -> bool:
    doubled = (int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost, not overlapping within a kind; failing matches go without retry."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", end if m else at + 1)
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in map(s.count, set(s)))


def _iban_holds(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _sign(value: bool | None) -> str:
    return "0" if value is None else "+" if value else "-"


def votes(kind: str, span: str, before: str) -> str:
    """One of + - 0 for each of LABELERS."""
    low = before.lower()
    near = re.findall(r"[^\W\d_][\w-]*", low)[-4:]
    if kind == "secret":
        strict = bool(re.fullmatch(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{16,64}", span)) and not span.isdigit() and not span.isalpha()
        known = True if span.startswith(_PREFIXES) or re.search(rf"({'|'.join(_KEY_NAMES)})[\s\"'=:]*$", low) else None
        texture = _entropy(span) > 2.8 and any(map(str.isdigit, span)) and any(map(str.isalpha, span))
    elif kind == "phone":
        strict = bool(re.fullmatch(r"\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}", span))
        known = span.lstrip("(")[0] not in "01"
        texture = len({c for c in span if c.isdigit()}) > 3
    elif kind == "email":
        strict, texture = True, None
        known = re.split(r"[^A-Za-z0-9-]+", span.rstrip("])"))[-1].lower() in _DOMAINS
    elif kind == "national_id":
        strict = span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
        known, texture = False if span in _PUBLIC_IDS else None, len(set(span)) > 4
    else:
        strict, texture = _iban_holds(span), None
        known = _IBAN_LENGTHS.get(span[:2]) == len(span.replace(" ", ""))
    return "".join((_sign(strict), _sign(known), "+" if any(w in _FOR[kind] for w in near) else "0", "-" if any(w in _AGAINST for w in near) else "0", _sign(texture)))


def shape(kind: str, span: str) -> str:
    """The classifier's features of a span, as |-joined names; few distinct ones."""
    digits, letters = sum(map(str.isdigit, span)), sum(map(str.isalpha, span))
    part = lambda n: str(4 * n // len(span))
    names = [kind, f"len{min(len(span).bit_length(), 7)}", f"dig{part(digits)}", f"let{part(letters)}"]
    names += [n for n, ok in (("upper", span.isupper()), ("lower", span.islower()), ("hex", bool(re.fullmatch("[0-9a-f]+", span))), ("digits", span.isdigit()), ("alpha", span.isalpha())) if ok]
    return "|".join(names)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(kind, start, end, votes, shape) of wide matches that touch no base span or earlier match."""
    taken, out = bytearray(len(text)), []
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    for kind, wide in _WIDE:
        for m in wide.finditer(text):
            s, e = m.span(1)
            other = taken.find(1, s, e)
            if kind == "secret" and other - s >= LEAST_LEFT:
                e, other = other, -1
            if other < 0:
                taken[s:e] = b"\1" * (e - s)
                out.append((KINDS.index(kind), s, e, votes(kind, text[s:e], text[max(0, s - 48) : s]), shape(kind, text[s:e])))
    return out


_SPAN = "struct<kind:int,start:int,end:int>"
_CANDIDATE = "struct<kind:int,start:int,end:int,votes:string,shape:string>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, found): base spans and judged candidates of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        candidate = pa.struct([*span, ("votes", pa.string()), ("shape", pa.string())])
        names = ("kind", "start", "end", "votes", "shape")
        for b in batches:
            base, found = [], []
            for t in b.column(1):
                t = t.as_py() or ""
                spans = base_spans(t)
                base.append([dict(zip(names, x, strict=False)) for x in spans])
                found.append([dict(zip(names, x, strict=True)) for x in candidates(t, spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(candidate))], names=[key, "base", "found"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, base array<{_SPAN}>, found array<{_CANDIDATE}>")


def fit_labelers(patterns: list[str], counts: np.ndarray, rounds: int = 200, held: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, rates[class, labeler, vote]) by EM; votes in the order - 0 +.

    Starts from labelers that are right four times in five when they vote. That start also counts
    as `held` candidates of either class, so that the classes keep their sense where candidates are
    few; where they are many the votes decide.
    """
    codes = np.array([["-0+".index(v) for v in p] for p in patterns])
    start = np.array([(0.4, 0.5, 0.1), (0.1, 0.5, 0.4)])
    rates = np.repeat(start[:, None, :], codes.shape[1], axis=1)
    prior, place = 0.5, np.arange(codes.shape[1])
    for _ in range(rounds):
        logs = np.log(rates)[:, place, codes].sum(2)
        odds = logs[1] - logs[0] + math.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip((post @ counts + 1) / (counts.sum() + 2), 0.02, 0.98))
        for y, w in ((1, post * counts), (0, (1 - post) * counts)):
            for v in range(3):
                rates[y, :, v] = ((codes == v).T @ w + held * start[y][v]) / (w.sum() + held)
    return post, rates


def _features(kind: str, votes_: str, shape_: str) -> list[str]:
    return [kind, *(f"{kind}:{n}{v}" for n, v in zip(LABELERS, votes_, strict=True)), *shape_.split("|")[1:]]


def fit_spans(spans: list[tuple[str, str, str]], targets: np.ndarray, counts: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Probability of each (kind, votes, shape): logistic regression on their names, soft targets, by Newton steps."""
    names = sorted({n for s in spans for n in _features(*s)})
    x = np.array([[n in own for n in names] + [True] for own in (set(_features(*s)) for s in spans)], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (counts * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (counts * (p - targets)) + ridge * w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def verdicts(seen: dict[tuple[str, str, str], int], threshold: float = 0.5) -> set[tuple[str, str, str]]:
    """The accepted among counted (kind, votes, shape): labelers weighed kind by kind, then the classifier's word."""
    spans = sorted(seen)
    if not spans:
        return set()
    counts = np.array([seen[s] for s in spans], float)
    post = np.zeros(len(spans))
    for kind in {s[0] for s in spans}:
        own = np.array([s[0] == kind for s in spans])
        post[own] = fit_labelers([s[1] for s in spans if s[0] == kind], counts[own])[0]
    return {s for s, p in zip(spans, fit_spans(spans, post, counts), strict=True) if p >= threshold}


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, base, spans): arrays of (kind, start, end); spans holds base and what the classifier accepts."""
    scanned = written(scan(docs, key, text), "pii")
    seen = scanned.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n")).collect()
    accepted = verdicts({(KINDS[r["kind"]], r["votes"], r["shape"]): r["n"] for r in seen}, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            out = []
            for base, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                more = [{k: c[k] for k in ("kind", "start", "end")} for c in found if (KINDS[c["kind"]], c["votes"], c["shape"]) in accepted]
                out.append(sorted(base + more, key=lambda s: (s["kind"], s["start"])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, span)], names=[key, "base", "spans"])

    kind = dict(scanned.dtypes)[key]
    return scanned.mapInArrow(run, f"{key} {kind}, base array<{_SPAN}>, spans array<{_SPAN}>")


def redact(text: str, spans: list[dict]) -> str:
    """text with each span as [KIND]; of overlapping spans the first stands."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            at = s["end"]
    return "".join([*out, text[at:]])


def _listed(spans) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in spans)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
            counts = np.array([[sum(s["kind"] == k for s in x) for k in range(4)] for x in base], np.int64).reshape(-1, 4)
            hashes = [hashlib.sha256(_listed(x).encode()).hexdigest() for x in base]
            found_ = [pa.array([_listed(x) for x in spans], pa.string()), pa.array([len(x) for x in spans], pa.int64())]
            columns = [b.column(0), *(pa.array(counts[:, k].copy()) for k in range(4)), pa.array(hashes, pa.string()), *found_]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])

    kind = dict(found.dtypes)["doc_id"]
    return found.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
