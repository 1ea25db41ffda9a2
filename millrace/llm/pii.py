"""Personal data spans: exact base patterns, and more by weak supervision.

Base spans (kinds email, ip, card, phone) follow fixed patterns and always stay.
The method adds spans for strings of looser shape:

* candidates: looser patterns of the four kinds;
* three labelers vote +1, 0 or -1 on each candidate: *regex* (does the string have
  the kind's usual written form?), *gazetteer* (top-level domains, card issuer
  prefixes, country and area codes, reserved address blocks) and *context* (words
  before it, and what touches it);
* expectation-maximisation estimates, for each kind, the class prior and each
  labeler's distribution of votes given the class, from the counts of vote
  patterns over all documents;
* a logistic span classifier is fitted to the estimated class probabilities on
  votes and shape features, again from counts, and decides on every candidate.

There are at most 4 * 27 * 16 patterns, so what the driver sees is bounded; the
texts are scanned once, and candidates wait in the shared folder for the model.

Patterns are tried only where a span can begin, and none backtracks over a long
run, so a scan is linear in the text.

Edge cases: null and empty texts have no spans; spans are code points, end
exclusive; an added span that overlaps a base span of any kind is dropped, as are
overlapping added ones but the first by start, then kind; repeated rows give one
row each; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read_table, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE, STEPS, ACCEPT = 50, 0.5, 400, 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        elif start < at:
            free = at  # runs before this sign are done with
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Valid spans by kind, leftmost and non-overlapping within the kind."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return [_emails(text), ips, cards, phones]


# Gazetteers.
DOMAINS = frozenset("com org net edu gov int info biz io de fr es uk it nl eu ch at be us ca au jp".split())
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "60", "62", "65")
COUNTRIES = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CUES = {
    "email": frozenset("mail email e-mail contact write courriel correo".split()),
    "ip": frozenset("ip address host server adresse dirección".split()),
    "card": frozenset("card visa mastercard credit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile telefon téléphone teléfono".split()),
}
#: What looks like a number of another sort when it stands before.
COUNTER_CUES = frozenset("version v isbn id no token key".split())

_LOOSE = (
    re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+)+"),
    re.compile(r"(?<![\w.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![\w.]*[0-9])"),
    re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}+(?![\w-])"),
    re.compile(r"(?<![\w.])(?:\+|00)?\(?[0-9]{1,4}+\)?(?:[ .-]?\(?[0-9]{2,4}+\)?){2,4}+(?![\w.-]*[0-9])"),
)
_USUAL = (
    re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|\Z)){4}"),
    re.compile(r"[0-9]{15,16}|[0-9]{4}(?:[ -][0-9]{4}){3}"),
    re.compile(r"(?:\+|00)[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}"),
)
_WORD = re.compile(r"[\w-]+")


def _votes(kind: int, text: str, start: int, end: int) -> tuple[int, int, int]:
    """Votes of regex, gazetteer and context."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    usual = 1 if _USUAL[kind].fullmatch(s) else -1
    if kind == 0:
        known = 1 if s.rsplit(".", 1)[-1].lower() in DOMAINS else -1
    elif kind == 1:
        first = int(s.split(".")[0])
        known = -1 if first in (0, 127) or first >= 240 else 1
    elif kind == 2:
        known = (1 if digits.startswith(ISSUERS) else 0) if luhn(digits) else -1
    else:
        known = 1 if s[0] == "+" and digits.startswith(COUNTRIES) else (0 if s[0] in "+(" else -1)
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    touch = text[start - 1 : start] + text[end : end + 1]
    if any(w in CUES[KINDS[kind]] for w in before):
        context = 1
    elif any(w in COUNTER_CUES for w in before[-2:]) or any(c in "\"'=/\\#_" for c in touch):
        context = -1
    else:
        context = 0
    return usual, known, context


def _code(kind: int, votes: tuple[int, int, int], s: str) -> int:
    """Kind, votes and shape (length, separators) in one small number."""
    n = sum("0" <= c <= "9" for c in s)
    seps = min(3, sum(not c.isalnum() for c in s))
    size = min(3, (n if kind else len(s)) // (4 if kind else 12))
    v = (votes[0] + 1) * 9 + (votes[1] + 1) * 3 + votes[2] + 1
    return (kind * 27 + v) * 16 + size * 4 + seps


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code): base spans, and looser strings that no base span overlaps."""
    taken = sorted(x for spans in base for x in spans)
    out = [(k, a, b, _code(k, _votes(k, text, a, b), text[a:b])) for k, spans in enumerate(base) for a, b in spans]
    if not any("0" <= c <= "9" for c in text) and "@" not in text and "at" not in text:
        return out
    for k, pattern in enumerate(_LOOSE):
        i = 0
        for m in pattern.finditer(text):
            a, b = m.span()
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if not any(x < b and a < y for x, y in taken[max(0, i - 4) : i + 4]):
                out.append((k, a, b, _code(k, _votes(k, text, a, b), m[0])))
    return out


def _scan(batches):
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32()), ("base", pa.bool_())])
    for batch in batches:
        found = []
        for text in batch.column(1):
            t = text.as_py() or ""
            base = base_spans(t)
            own = {(k, a, b) for k, spans in enumerate(base) for a, b in spans}
            found.append([{"kind": k, "start": a, "end": b, "code": c, "base": (k, a, b) in own} for k, a, b, c in candidates(t, base)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["id", "spans"])


def _split(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, v, shape = code // 16 // 27, code // 16 % 27, code % 16
    return kind, np.stack([v // 9, v // 3 % 3, v % 3], axis=1), shape


def estimate(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probability that a candidate of each code is personal data, by EM over the labelers' votes."""
    kind, votes, _ = _split(code)
    out = np.zeros(len(code))
    for k in range(len(KINDS)):
        own = kind == k
        if not own.any():
            continue
        v, n = votes[own], count[own].astype(float)
        q = np.clip(0.5 + 0.2 * (v - 1).sum(axis=1), 0.05, 0.95)  # majority to begin with
        for _ in range(ROUNDS):
            prior = np.clip((n * q).sum() / n.sum(), 0.02, 0.98)
            logit = np.full(len(v), np.log(prior / (1 - prior)))
            for j in range(3):
                yes = np.array([(n * q)[v[:, j] == x].sum() + 1 for x in range(3)])
                no = np.array([(n * (1 - q))[v[:, j] == x].sum() + 1 for x in range(3)])
                # a positive vote is never evidence against, nor a negative one for
                weight = np.log(yes / yes.sum()) - np.log(no / no.sum())
                weight[2], weight[0] = max(weight[2], 0.0), min(weight[0], 0.0)
                logit += weight[v[:, j]]
            q = 1 / (1 + np.exp(-logit))
        out[own] = q
    return out


def _features(code: np.ndarray) -> np.ndarray:
    kind, votes, shape = _split(code)
    one = lambda x, n: np.eye(n)[x]
    votes_by_kind = [one(kind * 3 + votes[:, j], 3 * len(KINDS)) for j in range(3)]
    return np.concatenate([one(kind, len(KINDS)), *votes_by_kind, one(kind * 16 + shape, 16 * len(KINDS))], axis=1)


def classifier(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Probabilities by a logistic model fitted to the EM estimates, for the same codes."""
    x, q = _features(code), estimate(code, count)
    n = np.log1p(count)  # a pattern's say grows slowly with its count
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-x @ w))
        w -= RATE * (x.T @ (n * (p - q)) / n.sum() + 1e-4 * w) * 4
    return 1 / (1 + np.exp(-x @ w))


def _result(accepted: frozenset[int]):
    def run(batches):
        for batch in batches:
            counts, base_text, all_text, total = [], [], [], []
            for spans in batch.column(1).to_pylist():
                base = sorted((s["kind"], s["start"], s["end"]) for s in spans if s["base"])
                more, end = [], 0
                for s in sorted((s for s in spans if not s["base"] and s["code"] in accepted), key=lambda s: (s["start"], s["kind"])):
                    if s["start"] >= end:
                        more.append((s["kind"], s["start"], s["end"]))
                        end = s["end"]
                counts.append([sum(k == x for k, _, _ in base) for x in range(len(KINDS))])
                show = lambda rows: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in rows)
                base_text.append(show(base))
                all_text.append(show(sorted(base + more)))
                total.append(len(base) + len(more))
            columns = [pa.array([c[x] for c in counts], pa.int64()) for x in range(len(KINDS))]
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in base_text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digest, pa.string()), pa.array(all_text, pa.string()), pa.array(total, pa.int64())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, accept: float = ACCEPT) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans); the counts by kind and the digest are of base spans, ``n_spans`` counts all."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, _ = written(map_arrow(rows, _scan, f"id {kind}, spans array<struct<kind:int,start:int,end:int,code:int,base:boolean>>"), "pii-candidates")
    seen = found.select(F.explode("spans.code").alias("code")).groupBy("code").count().orderBy("code").collect()
    code, count = np.array([r["code"] for r in seen], int), np.array([r["count"] for r in seen], int)
    p = classifier(code, count) if len(code) else np.empty(0)
    accepted = frozenset(int(c) for c in code[p >= accept])
    return map_arrow(found, _result(accepted), f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
