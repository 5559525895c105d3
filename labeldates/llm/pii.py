"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what they miss.

Fixed patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers. The CRF reads
the words of a whole text as one chain; a word's features are its own shape and the shapes around it (letters and digits
as classes, runs joined, a few cue words as themselves). It is trained from the small labelled table below, its slots
filled by rule, and decoded by Viterbi in numpy batches. It adds numbers and addresses in other notations: national
phone numbers, card numbers with a wrong check digit or other separators, written-out addresses ("ana (at) site (dot)
org"), in the languages of the table's sentences (English, German, French, Spanish). Spans that touch one of a fixed
pattern are dropped; the fixed ones stay.

All pattern scans are linear in the text: no position is tried from inside a run that has failed from its start.

Defined cases: null text counts as empty and has no span. Null ids and repeated rows are carried row by row. Extra
columns are ignored by ``scan`` and kept by ``masked``. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            past = m.end()
        else:
            past = at + 1
        at = text.find("@", past)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    if text.count(".") > 2:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


# --- the CRF

LABELS = ("none", *KINDS)
CUES = frozenset((
    "at dot phone tel telephone call fax mobile mail email e-mail card visa ip contact version isbn order page year invoice com org net in on from de es fr mastercard number no "
    "punkt telefon anrufen handy mobil karte kartennummer rechnung seite jahr adresse kontakt nummer "
    "arobase point téléphone portable appelez carte numéro facture année adresse courriel "
    "arroba punto teléfono móvil llame llama tarjeta número factura página año correo"
).split())
# The labelled table: words, each slot in braces with the label of its words. Fixed by hand; slots are filled by rule.
SENTENCES = (
    "please call {phone} for help", "tel {phone}", "phone : {phone} or {phone}", "the office {phone} is open", "{phone}", "fax {phone} , mail {email}", "my number is {phone} .", "of the {phone} and then", "mobile {phone} ext 4",
    "write to {email} today", "{email}", "contact {email} or {phone}", "e-mail : {email}", "send it to {email} .", "the {email} of the list",
    "card {card} expires soon", "{card}", "pay with {card} please", "visa {card} .", "the of {card} in and", "ended {card} that the", "his {card} , her {card}",
    "host {ip} is down", "from {ip} to {ip}", "{ip}", "ip {ip} port 80", "the {ip} in log",
    "in the year {n4} there were {n2} of them", "order {n6} shipped on {date}", "page {n2} of {n3}", "version {v3} was out", "isbn {isbn}", "from {n4} to {n4}", "it cost {price} in all", "at {time} on {date}", "the {n3} , {n2} and {n1}", "invoice {n8} for {n1} items",
    "{w} {w} {w} {w} {w} .", "{w} {w} at {w} {w}", "the {w} of {w} , {w} at the {w}", "{w} dot {w} in {w}", "{W} {w} {w} . {W} {w}", "{w} | {w} | {w}", "{w}*** {w}### {w}", "room {n3} at the {w}", "token = {hex}", "{w} {hex} {w}", "{n12} {w}", "{n10} {w} {w}", "{W} {W} {W}", "{w} {n2}", "chapter {n1} {w} {n2}", "{w} at at at at at {w}", "{w} {w} at {w} at {w} {w} dot {w}", "At {w} , {w} at the {w} . {w} {w}", "call me at {phone} or mail {email} and {card} .", "{email} and {w} {w} {card} , version {v3} of {date} , {n8} {w} at {time}", "{card} {w} {email} {w} {w} {phone} {w} {w} {ip} {w}",
    "{w} {email} {W} {w} {w} at {w} {w} .", "{w} at {W} and {W} at {w} ( {w} )", "{w} ( {w} ) {w} [ {w} ] ({w}) [{w}]", "{price} or {price}", "{n20}",
    "{w} write to {written} {w}", "mail {written} .", "{w} {w} {written} and {w}", "{written}", "{w} looks at {w} dot {w}", "meet at {W} , dot {w} {w}", "{w} dot {w} at {w} {w} .",
    "Tel. {national} {w}", "Telefon : {national}", "ruf {national} an", "unter {national} oder {email}", "Handy {national} .", "die Nummer {national} {w}", "E-Mail : {written}", "schreib an {written} {w}", "Karte {card} {w}", "Kartennummer {card} .", "im Jahr {n4} waren es {n2} {W}", "Rechnung {n8} vom {date}", "Seite {n2} von {n3}", "{W} {w} {w} {n3} {W} .", "ISBN {isbn} {w}",
    "Tél. {national} {w}", "téléphone : {national}", "appelez le {national} {w}", "au {national} ou {email}", "portable {national} .", "mon numéro est le {national}", "courriel : {written}", "écrivez à {written} {w}", "carte {card} {w}", "en {n4} il y avait {n2} {w}", "facture {n8} du {date}", "page {n2} sur {n3}", "{w} {w} de {n3} {w} {n1} .",
    "Tel. {national} {w}", "teléfono : {national}", "llame al {national} {w}", "móvil {national} o {email}", "mi número es {national} .", "correo : {written}", "escriba a {written} {w}", "tarjeta {card} {w}", "en el año {n4} hubo {n2} {w}", "factura {n8} del {date}", "página {n2} de {n3}", "{w} {w} {n3} {w} y {n2} .",
    "{national}", "call {national} now", "please call {national} {w}", "{w} {w} {big} {w} {w}", "{w} {big} {w} in {n4}", "{n2} {n2} {n2} {w}", "{n2} {n1}.5 {n2} {n2} {n2} {w}", "{n2} {n2} {n1}.5 {w} {n1}.5", "{n4} {n4} {w}", "{w} {n1} {n2} {n3} {w}", "{n5} {w} {n5}", "{w} at {w} at {w} dot",
)


class Shapes(dict):
    """Word to shape id, remembered up to a bound."""

    SIZE = 4096

    def __missing__(self, word: str) -> int:
        import zlib

        if len(self) > 150_000:
            self.clear()
        self[word] = found = zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % (self.SIZE - 1) + 1
        return found


def shape(word: str) -> str:
    """Runs of letters as ``x`` or ``X``, of digits as ``d`` with their length, other characters as they are; cue words
    as themselves."""
    core = word.strip(".,;:!?\"'|*#$%&")
    if core.strip("()[]").lower() in CUES:
        return core.lower()
    if core.isalpha():
        return "x"
    core = word.rstrip(".,;:!?\"'|*#$%&").lstrip("\"'|*#$%&")
    out = re.sub(r"[^\W\d_]+", "x", core)
    return re.sub(r"\d+", lambda m: f"d{min(len(m[0]), 20)}", out) or "mark"


def _fill(slot: str, rng: np.random.Generator) -> str:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick(*"abcdefghilmnoprstuvw") for _ in range(int(rng.integers(2, 10))))
    if slot == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}")
    if slot == "national":  # of the countries of the table's languages
        a, b, c, d = (digits(2) for _ in range(4))
        return pick(
            f"0{digits(3)} {digits(6)}", f"0{digits(2)}/{digits(7)}", f"0{digits(2)} {digits(7)}", f"0{digits(3)}-{digits(7)}", f"0{digits(3)}/{digits(6)}", f"(0{digits(2)}) {digits(7)}", f"0{digits(3)} {digits(3)} {digits(4)}", f"0{digits(10)}",
            f"0{digits(1)} {a} {b} {c} {d}", f"0{digits(1)}.{a}.{b}.{c}.{d}", f"0{digits(1)}-{a}-{b}-{c}-{d}", f"0{digits(9)}",
            f"{pick('6', '7', '9')}{digits(2)} {digits(3)} {digits(3)}", f"{pick('6', '9')}{digits(2)} {a} {b} {c}", f"{pick('6', '9')}{digits(2)}-{digits(3)}-{digits(3)}", f"{pick('6', '9')}{digits(8)}",
        )
    if slot == "written":
        a, b, c = word(), word(), pick("com", "org", "net", "de", "es", "fr", "com", word())
        at, dot = pick(("at", "dot"), ("at", "dot"), ("at", "punkt"), ("arobase", "point"), ("arroba", "punto"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "(punkt)"), ("(arobase)", "(point)"), ("(arroba)", "(punto)"))
        return pick(f"{a} {at} {b} {dot} {c}", f"{a} {dot} {word()} {at} {b} {dot} {c}", f"{a}{digits(2)} {at} {b} {dot} {c}", f"{a}.{word()} {at} {b}.{c}", f"{a}_{digits(1)} {at} {b} {dot} {word()} {dot} {c}")
    if slot == "email":
        a, b, c = word(), word(), pick("com", "org", "net")
        return pick(f"{a} (at) {b} (dot) {c}", f"{a} [at] {b} [dot] {c}", f"{a}@{b}.{c}", f"{a}.{digits(2)}@{b}.{c}", f"{a}(at){b}.{c}", f"{a}[at]{b}[dot]{c}")
    if slot == "card":
        a = [digits(4) for _ in range(4)]
        return pick("".join(a), "".join(a), "".join(a), "-".join(a), " ".join(a), ".".join(a), digits(15), f"{digits(4)} {digits(6)} {digits(5)}")
    if slot == "ip":
        return ".".join(str(int(x)) for x in rng.integers(0, 256, 4)) + pick("", "", ":80", "/24")
    if slot == "date":
        return pick(f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}.{digits(2)}.{digits(4)}")
    if slot == "hex":
        return '"' + "".join(pick(*"0123456789abcdef") for _ in range(int(rng.integers(28, 41)))) + '"'
    made = {"time": f"{digits(2)}:{digits(2)}", "price": pick(f"{digits(2)}.{digits(2)}", f"${digits(3)}", f"{digits(1)},{digits(3)}"), "v3": f"{digits(1)}.{digits(1)}.{digits(2)}", "isbn": f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", "w": word(), "W": word().capitalize(), "big": f"{int(rng.integers(1, 9))}{digits(int(rng.integers(0, 3)))} {digits(3)} {digits(3)}"}
    return made[slot] if slot in made else digits(int(slot[1:]))


def labelled(copies: int = 9, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The table's sentences with slots filled, as words and labels."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(copies):
        for sentence in SENTENCES:
            words, labels = [], []
            for token in sentence.split():
                m = re.fullmatch(r"\{(\w+)\}(\S*)", token)
                made = (_fill(m[1], rng) + m[2] if m else token).split()
                if rng.random() < 0.15:
                    made[-1] += "."
                words += made
                label = {"national": "phone", "written": "email"}.get(m[1], m[1]) if m else ""
                labels += [LABELS.index(label) if label in LABELS else 0] * len(made)
            rows.append((words, labels))
    return rows


def _ids(shapes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own shape, the two before, the two after and the pairs with the neighbours, each in its own range of ids."""
    n, size = len(shapes), Shapes.SIZE
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = starts + np.repeat(lengths, lengths)
    at = np.arange(n)
    near = {k: np.where((at + k >= starts) & (at + k < ends), shapes[np.clip(at + k, 0, max(n - 1, 0))], 0) for k in (-2, -1, 1, 2)}
    pair = lambda a, b: (a * 31 + b * 17) % size
    return np.stack([shapes, *(near[k] + size * (i + 1) for i, k in enumerate((-2, -1, 1, 2))), pair(near[-1], shapes) + 5 * size, pair(shapes, near[1]) + 6 * size], axis=1)


def chained(rows: list[tuple[list[str], list[int]]], seed: int = 6) -> list[tuple[list[str], list[int]]]:
    """The rows in another order, up to six of them joined: a text is read as one chain, so the model must see what follows
    a number or an address other than the end."""
    rng, out, at = np.random.default_rng(seed), [], 0
    order = rng.permutation(len(rows))
    while at < len(order):
        part = [rows[k] for k in order[at : at + int(rng.integers(1, 7))]]
        out.append(([w for words, _ in part for w in words], [x for _, labels in part for x in labels]))
        at += len(part)
    return out


def train(copies: int = 18) -> crf.Crf:
    rows, shapes = chained(labelled(copies)), Shapes()
    lengths = np.array([len(w) for w, _ in rows])
    flat = np.array([shapes[w] for words, _ in rows for w in words])
    model = crf.train(_ids(flat, lengths), lengths, np.array([x for _, labels in rows for x in labels]), 7 * Shapes.SIZE, len(LABELS))
    model.weights = model.weights.astype(np.float32)
    return model


CARD_GROUPS = re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}")
# An address has a sign for "at" and letters on both sides, in whatever notation.
AT_SIGN = re.compile(r"@|(?<![^\W_])(?:at|arobase|arroba)(?![^\W_])", re.I)
# Two signs side by side ("dot dot", "at dot") stand in no address.
_SIGN = r"(?<![^\W_])(?:at|arobase|arroba|dot|punkt|point|punto)(?![^\W_])"
SIGNS_MEET = re.compile(rf"{_SIGN}[)\]]?\s+[(\[]?{_SIGN}", re.I)
_WORD = re.compile(r"\S+")
_EDGE_LEFT, _EDGE_RIGHT = "\"'|*#$%&,;:!?[{<", "\"'|*#$%&,;:!?.]}>"


def model_spans(model: crf.Crf, texts: list[str], shapes: Shapes) -> list[list[tuple[str, int, int]]]:
    """What the CRF finds in each text, before the fixed patterns take precedence."""
    words = [t.split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not lengths.sum():
        return out
    flat = np.fromiter((shapes[w] for ws in words for w in ws), np.int32, int(lengths.sum()))
    ids = _ids(flat, lengths)
    emissions = model.weights[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        emissions = emissions + model.weights[ids[:, k]]
    labels = model.viterbi(emissions, lengths)
    starts = np.cumsum(lengths) - lengths
    hits = np.flatnonzero(labels)
    for d in np.unique(np.searchsorted(starts + lengths, hits, "right")):
        text, own = texts[d], labels[starts[d] : starts[d] + lengths[d]]
        at = [m.span() for m in _WORD.finditer(text)]
        i = 0
        while i < len(own):
            j = i + 1
            if own[i]:
                while j < len(own) and own[j] == own[i] and "\n" not in text[at[j - 1][1] : at[j][0]]:
                    j += 1
                out[d] += pieces(LABELS[own[i]], text, at[i][0], at[j - 1][1])
            i = j
    return out


def pieces(kind: str, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """The run of words as spans: edges trimmed, and only with what its kind must have."""
    while a < b and text[a] in _EDGE_LEFT:
        a += 1
    while b > a and text[b - 1] in _EDGE_RIGHT:
        b -= 1
    found = text[a:b]
    digits = sum(c.isdigit() for c in found)
    if kind == "email":
        sign = AT_SIGN.search(found)
        return [(kind, a, b)] if sign and not SIGNS_MEET.search(found) and any(map(str.isalpha, found[: sign.start()])) and any(map(str.isalpha, found[sign.end() :])) else []
    least, most = {"ip": (4, 16), "card": (13, 19), "phone": (9, 15)}[kind]
    if " " in found and (digits > most or kind == "card" and not CARD_GROUPS.fullmatch(found)):  # several numbers in a row
        return [x for m in _WORD.finditer(found) for x in pieces(kind, text, a + m.start(), a + m.end())]
    return [(kind, a, b)] if least <= digits <= most and sum(map(str.isalpha, found)) <= 1 and (kind != "ip" or found.count(".") == 3) else []


def _added(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``more`` that touch none of ``base``, by one sweep over both."""
    out, ends, i = [], sorted((a, b) for _, a, b in base), 0
    reach = 0  # the furthest end of all that begin before the span in hand ends
    for x in sorted(more, key=lambda x: x[2]):
        while i < len(ends) and ends[i][0] < x[2]:
            reach = max(reach, ends[i][1])
            i += 1
        if reach <= x[1]:
            out.append(x)
    return out


def spans(model: crf.Crf, texts: list[str], shapes: Shapes) -> Iterator[tuple[list, list]]:
    """Of each text the fixed spans and all spans, both by kind as listed, then start."""
    for text, more in zip(texts, model_spans(model, texts, shapes), strict=True):
        base = base_spans(text)
        yield base, sorted([*base, *_added(base, more)], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices whose texts have at most about 1.5 M characters together, one text at least."""
    sizes = np.cumsum([len(x.as_py() or "") + 64 for x in batch.column(at)])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + 1_500_000, "right")))
        part = batch.slice(i, j - i)
        yield part, [x or "" for x in part.column(at).to_pylist()]
        i = j


def _scan(model: crf.Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            for part, texts in _texts(batch, 1):
                rows = [(*(sum(k == kind for k, _, _ in base) for kind in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)) for base, every in spans(model, texts, shapes)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4]), pa.array(cols[5], pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(common.in_arrow, _scan(model or train()), SCHEMA)


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """Each span as ``<KIND>``; spans that overlap become one, named by the first."""
    out, past = [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
        if a >= past:
            out += [text[past:a], f"<{kind.upper()}>"]
        past = max(past, b)
    return "".join(out) + text[past:]


def _mask(model: crf.Crf, text_at: int, chars_at: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            for part, texts in _texts(batch, text_at):
                made = [mask(t, every) if every else t for t, (_, every) in zip(texts, spans(model, texts, shapes), strict=True)]
                cols = list(part.columns)
                null = part.column(text_at).is_null().to_pylist()
                cols[text_at] = pa.array([None if x else t for x, t in zip(null, made, strict=True)], part.schema.field(text_at).type)
                if chars_at is not None:
                    cols[chars_at] = pa.array([n if t == old else len(t) for n, t, old in zip(cols[chars_at].to_pylist(), made, texts, strict=True)], part.schema.field(chars_at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return run


def masked(docs: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """``docs`` with its columns, personal data in ``text`` replaced by the name of its kind, ``n_chars`` brought up to
    date where the text has changed."""
    names = docs.columns
    return docs.transform(common.in_arrow, _mask(model or train(), names.index("text"), names.index("n_chars") if "n_chars" in names else None), docs.schema)
