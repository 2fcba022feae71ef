"""Personal data by weak supervision.

Four base kinds (email, ip, card, phone) are found by exact patterns and always kept. The method adds spans: every candidate
(base matches, failed base matches, spelled-out addresses, long numbers and long mixed strings) gets votes from labelers: the
kind's check (regex), lists of cue words before it (gazetteer), counter-cues such as licence and version words, and its context
(assignment, quotes, neighbours). Votes are counted by pattern over the whole corpus, expectation-maximisation on these counts
(a Dawid-Skene model per kind) estimates each labeler's reliability, and the posteriors train a logistic regression over the
candidates' categorical features, which is the final span classifier. Added spans never overlap base spans or each other.

What reaches the driver is one row per distinct feature tuple. Every feature has a fixed small domain, so their number has a
bound that does not depend on the corpus. Null text is empty and has no spans; a null doc_id is a row like any other, repeated
rows stay repeated, an empty table gives an empty table, and columns besides doc_id and text are ignored. Spans are in code
points, end exclusive. All patterns run in linear time on any text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import blocks, rewrite, table, texts, with_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "number", "address")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[ ./()-]{0,2}[0-9]){6,}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,64})+")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile(r"[A-Za-z0-9_/+=-]*")
_MIXED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+=-")

# Cue words before a candidate, by kind, and words that speak against it.
_CUES = {
    "email": ("mail", "contact", "contacto", "kontakt", "write", "schreib", "escrib", "courriel"),
    "ip": ("ip", "host", "server", "addr", "client"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "konto", "credit"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "handy", "appel", "llama"),
    "secret": ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential"),
    "number": ("phone", "tel", "call", "card", "account", "konto", "ssn", "passport", "iban"),
    "address": ("mail", "contact", "kontakt", "write"),
}
_COUNTER = ("version", "license", "licence", "isbn", "issn", "doi", "commit", "sha", "md5", "http", "page", "chapter", "rfc", "section")
# How well-known access keys and tokens begin.
_KEY = re.compile("AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|eyJ")

_WORDS = re.compile("(?:[A-Za-z]++|[0-9]++)(?:[-_/+=]++(?:[A-Za-z]++|[0-9]++))*+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """kind, start, end and whether the kind's check passes, for every leftmost non-overlapping match of the base patterns."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append(("email", start, end, True))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if m.group().count(".") >= 3:
                # a maximal dotted run holds a match for every four parts in turn
                parts, place = m.group().split("."), m.start()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    size = sum(map(len, four)) + 3
                    out.append(("ip", place, place + size, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)))
                    place += size + 1
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if len(d) >= 13:
                out.append(("card", m.start(), m.end(), len(d) <= 19 and luhn(d)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                out.append(("phone", m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15))
    return out


def _more(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base patterns."""
    out, end = [], 0
    if "at" in text and ("(at" in text or "[at" in text):
        out += [("address", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    m = _DIGIT.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] in _MIXED:
            start -= 1
        end = max(_RUN.match(text, m.start()).end(), m.end())
        run = text[start:end].strip("=/+-_")
        if len(run) >= 20 and any(c.isalpha() for c in run):
            start = text.index(run, start, end)
            out.append(("secret", start, start + len(run)))
        m = _DIGIT.search(text, end)
    out += [("number", m.start(), m.end()) for m in _NUMBER.finditer(text)] if _DIGIT.search(text) else []
    return out


def _features(text: str, kind: str, start: int, end: int, checked: bool) -> tuple:
    """Votes (1 for, 0 none, -1 against) of the labelers and further categorical features of a candidate."""
    own, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 8]
    n_digits = sum("0" <= c <= "9" for c in own)
    size, named = min(4, len(own) // 10), False
    if kind == "secret":
        name, _, value = own.rpartition("=")
        named, before = bool(name), before + name.lower()  # name=value is one string
        letters = len(set(value.lower()))
        regex = 1 if _KEY.match(value) or len(value) in (32, 40, 64) or named and letters >= 8 else -1 if letters < 8 or _WORDS.fullmatch(value) else 0
    elif kind == "number":
        regex = 1 if n_digits in (9, 10, 11) and len(own) > n_digits else -1
    elif kind == "address":
        regex = 1
    else:
        regex = 1 if checked else -1
    gazetteer = 1 if any(w in before for w in _CUES[kind]) else 0
    counter = -1 if any(w in before for w in _COUNTER) else 0
    last = before.rstrip()[-1:]
    context = 1 if named or last and last in "=:\"'" else -1 if text[start - 1 : start].isalnum() or after[:1].isalnum() else 0
    around = text[max(0, start - 1) : start] + after[:1]
    shape = 1 if len(around) == 2 and not around[0].isalnum() and not around[0].isspace() and not around[1].isalnum() and not around[1].isspace() else -1 if any(map(str.isalnum, around)) else 0
    return (kind, regex, gazetteer, counter, context, shape, size, min(3, 4 * n_digits // max(1, len(own))))


def _free(found: list[tuple], base: list[tuple]) -> list[tuple]:
    """Those of found (in order of preference) that overlap neither base spans nor each other."""
    taken = bytearray(max(x[2] for x in [*found, *base]))  # a mark for each character up to the last span's end
    for _, s, e, ok in base:
        if ok:
            taken[s:e] = b"\1" * (e - s)
    out = []
    for x in found:
        if taken.find(1, x[1], x[2]) < 0:
            taken[x[1] : x[2]] = b"\1" * (x[2] - x[1])
            out.append(x)
    return out


def _candidates(text: str) -> tuple[list[tuple], list[tuple]]:
    base = base_candidates(text)
    failed = [(k, s, e) for k, s, e, ok in base if not ok]
    more = _more(text)
    found = [*(x for x in more if x[0] != "number"), *failed, *(x for x in more if x[0] == "number")]
    return base, [(k, s, e, _features(text, k, s, e, False)) for k, s, e in _free(found, base)] if found else []


def _observe(batches):
    """Counts of feature tuples over a partition; base matches are observed as well."""
    count: Counter = Counter()
    for t in blocks(batches):
        for text in t.column("text").to_pylist():
            base, found = _candidates(text)
            count.update(x[3] for x in found)
            count.update(_features(text, k, s, e, ok) for k, s, e, ok in base if ok)
    rows = list(count)
    columns = [pa.array([x[i] for x in rows], pa.string() if i == 0 else pa.int32()) for i in range(8)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(count.values()), pa.int64())], names=["kind", *(f"f{i}" for i in range(1, 8)), "n"])


_LABELERS = 5
#: What the first guess at the reliability of a kind's own check is worth, as a share of the kind's candidates.
_HELD = 0.1


def reliabilities(votes: dict[tuple, int], rounds: int = 60) -> tuple[float, np.ndarray]:
    """The share of true candidates and P(vote | truth, a vote) as an array (truth, labeler, against or for), by expectation-maximisation.

    A labeler that has no vote on a candidate says nothing about it.
    """
    patterns, n = np.array(list(votes), dtype=int), np.array(list(votes.values()), dtype=float)
    prior = 0.5
    # what is held before any data: it says which class is which, and the data, ten times as many for the check, say the rest
    held = np.array([[[2.0, 1.0]] * _LABELERS, [[1.0, 2.0]] * _LABELERS])
    held[:, 0] = np.array([[0.95, 0.05], [0.05, 0.95]]) * max(4.0, _HELD * n.sum())
    table_ = held / held.sum(axis=2, keepdims=True)
    for _ in range(rounds):
        p = _posterior(patterns, prior, table_)
        for truth, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(_LABELERS):
                got = np.array([w[patterns[:, j] == v].sum() for v in (-1, 1)])
                table_[truth, j] = (got + held[truth, j]) / (got + held[truth, j]).sum()
        prior = float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98))
    return prior, table_


def _posterior(patterns: np.ndarray, prior: float, table_: np.ndarray) -> np.ndarray:
    logs = np.log(table_)
    score = [sum(np.where(patterns[:, j] == 0, 0.0, logs[t, j, (patterns[:, j] + 1) // 2]) for j in range(_LABELERS)) for t in (0, 1)]
    return 1 / (1 + np.exp(np.clip(score[0] - score[1] + math.log((1 - prior) / prior), -50, 50)))


def train(counts: dict[tuple, int], rounds: int = 400, rate: float = 1.0) -> tuple[dict[tuple, float], dict]:
    """A probability for each feature tuple from the final classifier, and the labelers' reliabilities by kind."""
    by: dict[str, Counter] = defaultdict(Counter)
    for x, n in counts.items():
        by[x[0]][x[1 : 1 + _LABELERS]] += n
    models = {kind: reliabilities(votes) for kind, votes in by.items()}
    rows = list(counts)
    if not rows:
        return {}, models
    y = np.array([_posterior(np.array([x[1 : 1 + _LABELERS]]), *models[x[0]])[0] for x in rows])
    names = {v: i for i, v in enumerate(sorted({(j, v) for x in rows for j, v in enumerate(x)} | {("kind", x[0], j, v) for x in rows for j, v in enumerate(x[1:])}, key=repr))}
    design = np.zeros((len(rows), len(names) + 1))
    design[:, -1] = 1
    for i, x in enumerate(rows):
        design[i, [names[j, v] for j, v in enumerate(x)] + [names["kind", x[0], j, v] for j, v in enumerate(x[1:])]] = 1
    n = np.sqrt(np.array([counts[x] for x in rows], dtype=float))  # frequent tuples count more, but not all
    n /= n.sum()
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w -= rate * (design.T @ (n * (p - y)) + 1e-4 * w)
    return dict(zip(rows, (1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))).tolist(), strict=True)), models


_SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _apply(scores, least: float):
    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))
        score = scores.value
        for t in blocks(batches):
            out = []
            for text in t.column("text").to_pylist():
                base, found = _candidates(text)
                spans = [(k, s, e, True, 1.0) for k, s, e, ok in base if ok]
                spans += [(k, s, e, False, p) for k, s, e, x in found if (p := score.get(x, 0.0)) >= least]
                spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                out.append([dict(zip(("kind", "start", "end", "base", "score"), x, strict=True)) for x in spans])
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(out, kind)], names=["doc_id", "spans"])

    return run


def observe(docs: DataFrame) -> dict[tuple, int]:
    """How often each feature tuple occurs in the whole corpus."""
    features = ["kind", *(f"f{i}" for i in range(1, 8))]
    schema = "kind string, " + ", ".join(f"f{i} int" for i in range(1, 8)) + ", n long"
    found = texts(docs).mapInArrow(_observe, schema).groupBy(*features).agg(F.sum("n").alias("n"))
    return {tuple(r[:8]): r["n"] for r in found.collect()}


def find_spans(docs: DataFrame, least: float = 0.5, model: dict[tuple, float] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end, whether a base span, score) of every row; model defaults to one trained on docs."""
    if model is None:
        model, _ = train(observe(docs))
    return texts(docs).mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model), least), _SPANS)


def _masked(text: str, score: dict, least: float) -> str:
    base, found = _candidates(text)
    spans = sorted([(s, e, k) for k, s, e, ok in base if ok] + [(s, e, k) for k, s, e, x in found if score.get(x, 0.0) >= least])
    out, end = [], 0
    for s, e, k in spans:
        if s >= end:
            out += [text[end:s], f"<{k}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, least: float = 0.5, model: dict[tuple, float] | None = None) -> DataFrame:
    """docs with all columns, each span (of spans that overlap, the first) replaced by its kind in angle brackets."""
    if model is None:
        model, _ = train(observe(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rewrite(docs, lambda t: with_text(t, [_masked(x, shared.value, least) for x in t.column("text").to_pylist()]))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    many = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    # base spans of one kind stand in the order of BASE, then start; added spans of a base kind may stand among them
    return found.select(
        "doc_id", *(many(k).alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
