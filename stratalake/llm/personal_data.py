"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Five kinds of spans are found: email, ip, card, phone and secret (keys, tokens, passwords).  The base
spans are fixed patterns (BASE) and always stay; secrets have none.  Wider patterns propose further candidates: written-out
addresses, phone numbers without a plus, cards with other separators, IPv6 (also with `::`), values assigned to a
name of secrets, and long runs of letters and digits.  For every candidate, base ones too, LABELERS vote yes, no
or nothing: a form pattern, a validity check, a gazetteer (domain endings, card issuers, address
ranges, dialling codes, key prefixes), the words before it, and what touches it.  Votes are counted over all
documents by pattern (a bounded table: 5 kinds, 3 votes of 5 labelers, 4 lengths), expectation-
maximisation estimates each labeler's reliability from these counts, and a logistic classifier over
votes, kind and length is trained on the resulting probabilities.  Candidates that it accepts and that
touch no base span are added.

Places are code points, ends exclusive.  Defined results: a null text is empty and has no spans; rows
are kept one for one, so repeated rows and null ids stay; an empty table gives an empty result; without
any candidates the classifier accepts none.  All patterns scan a text in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, stats
from .tables import cut, mapped, pick

KINDS = ("email", "ip", "card", "phone", "secret")
#: The base patterns.  Possessive repeats and look-behinds change no match; they keep failing places linear.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Every match of a base or wide pattern, but values assigned to a name of secrets, holds one of these; each kind has its own.
DIGIT = re.compile("[0-9]")
AT = re.compile(r"@|[\[({]at[\])}]|\sat\s", re.I)
COLON = re.compile(r":[0-9a-f:]", re.I)

WIDE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:\[at\]|\(at\)|\{at\}|(?<=\s)at(?=\s)|@)\s?[A-Za-z0-9-]{1,63}+(?:(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|(?<=\s)dot(?=\s))\s?|\.)[A-Za-z0-9-]{1,63}+){1,4}", re.I)
_RUN = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})"
#: IPv6 in full and with `::`, which stands for one group at least (see `wider`); also after a label ("addr:") and before a colon of the sentence.
WIDE_IP = re.compile(rf"(?:(?<![0-9A-Za-z:.])|(?<=[g-z]:))(?:{_RUN}{{7}}|(?:{_RUN}{{0,6}})?::(?:{_RUN}{{0,6}})?)(?![0-9A-Za-z]|:[0-9A-Za-z:]|\.[0-9])", re.I)
WIDE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])")
WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z+.,-])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])")
_NAMES = r"(?:secret|token|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)"
_SIGN = r"[A-Za-z0-9+/_=~-]"
_WORDS = ("secret", "token", "passw", "pwd", "key", "credential")
#: A value of eight signs or more that is assigned to a name of secrets; runs of sixteen or more, of which those with digits and letters count.
ASSIGNED = re.compile(rf"{_NAMES}[\w-]{{0,32}}+[\"']?\s{{0,4}}(?:=>|:=|[=:])\s{{0,4}}[\"']?((?:{_SIGN}|[.!@#$%^&*]){{8,512}}+)", re.I)
RUN = re.compile(rf"{_SIGN}{{16,}}+")
KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}")
#: Gazetteers and context words: fixed values.
ENDINGS = frozenset("com org net edu gov mil int info biz name io ai co me tv eu de fr es it nl be at ch uk us ca au nz jp cn in br mx ar ru pl se no fi dk pt ie cz".split())
NEAR = {
    "email": frozenset("mail email e-mail contact write address reply correo kontakt courriel adresse".split()),
    "ip": frozenset("ip host server address node peer client remote adresse servidor".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon téléphone teléfono whatsapp".split()),
    "secret": frozenset("secret token password passwd pwd passwort key apikey api_key api-key access_key private_key auth bearer credential credentials".split()),
}
FAR = frozenset("version v release isbn issn doi page chapter section order invoice serial build rfc nr art §".split())
#: Words before a run that is a checksum or a name, not a secret.
PUBLIC = frozenset("commit sha sha1 sha256 sha512 md5 checksum hash digest revision uuid id public fingerprint etag http https www file path".split())
YES, NO, NONE = 1, 0, 2

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: a run of local characters, its @ and the domain behind it."""
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        at += 1
        if start < at - 1 and (m := EMAIL_DOMAIN.match(text, at)):
            floor = at = m.end()
            yield start, floor


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 9 <= len(digits(m.group())) <= 15:
            yield m.span()


BASE: tuple[Callable[[str], Iterator[Span]], ...] = (emails, ips, cards, phones)


def _matches(pattern: re.Pattern, sieve: re.Pattern) -> Callable[[str], Iterator[Span]]:
    """The pattern's matches, of which each text with one holds a match of `sieve`."""
    return lambda text: (m.span() for m in pattern.finditer(text)) if sieve.search(text) else iter(())


def _ipv6(text: str) -> Iterator[Span]:
    for m in WIDE_IP.finditer(text) if COLON.search(text) else ():
        if "::" not in m.group() or 1 <= sum(map(bool, m.group().split(":"))) <= 7:
            yield m.span()


def _secrets(text: str) -> Iterator[Span]:
    low = text.lower()
    spans = [m.span(1) for m in ASSIGNED.finditer(text)] if any(w in low for w in _WORDS) else []
    yield from spans
    for m in RUN.finditer(text) if DIGIT.search(text) else ():
        a, b = m.span()
        run = m.group()
        if any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run) and all(b <= c or d <= a for c, d in spans):
            yield a, b


WIDE: tuple[Callable[[str], Iterator[Span]], ...] = (_matches(WIDE_EMAIL, AT), _ipv6, _matches(WIDE_CARD, DIGIT), _matches(WIDE_PHONE, DIGIT), _secrets)


def base_spans(text: str) -> list[list[Span]]:
    """The base spans of each kind; secrets have none."""
    if not DIGIT.search(text):
        return [list(emails(text)), [], [], [], []]
    return [*(list(find(text)) for find in BASE), []]


def wider(text: str, taken: list[list[Span]]) -> Iterator[tuple[int, Span]]:
    """Further candidates that touch no base span."""
    flat = sorted(s for spans in taken for s in spans)
    starts = np.array([s for s, _ in flat], np.int64)
    for kind, find in enumerate(WIDE):
        for a, b in find(text):
            i = int(np.searchsorted(starts, b)) - 1
            if i < 0 or flat[i][1] <= a:
                yield kind, (a, b)


def votes(kind: int, text: str, a: int, b: int) -> tuple[int, ...]:
    """What each labeler says about a span."""
    span, number = text[a:b], digits(text[a:b])
    if kind == 0:
        parts = re.split(r"\s?(?:\[dot\]|\(dot\)|\{dot\}|\.|(?<=\s)dot(?=\s))\s?", span)
        ending = parts[-1].lower()
        form = YES if "@" in span and " " not in span else YES if re.search(r"[\[({]at[\])}]", span, re.I) else NO if re.search(r"\sat\s", span, re.I) and "dot" not in span.lower() else NONE
        valid = YES if ending.isalpha() and 2 <= len(ending) <= 24 else NO
        listed = YES if ending in ENDINGS else NO
    elif kind == 1:
        octets = span.split(".")
        form = YES if ":" in span or all(o == str(int(o or 0)) for o in octets if len(o) < 4) else NO
        valid = YES if ":" in span or all(len(o.lstrip("0")) <= 3 for o in octets) else NO
        listed = (YES if re.match(r"[23][0-9a-f]{3}:|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:", span, re.I) else NO if "::" in span else NONE) if ":" in span else YES if not re.match(r"0|127\.|2(?:2[4-9]|[3-5][0-9])\.", span) and any(len(o) > 1 for o in octets) else NO
    elif kind == 2:
        form = YES if re.fullmatch(r"[0-9]{13,19}|(?:[0-9]{4}([ ./_-]{1,2}))(?:[0-9]{4}\1){2}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else NO
        valid = YES if 13 <= len(number) <= 19 and luhn(number) else NO
        listed = YES if re.match(r"4|5[1-5]|2[2-7]|3[47]|35|36|6", number) else NO
    elif kind == 4:
        return _secret_votes(text, a, b)
    else:
        form = YES if re.fullmatch(r"(?:\+|00)[0-9 ().-]+|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span) else NO
        valid = YES if 9 <= len(number) <= 15 else NO
        listed = YES if span.startswith(("+", "00")) or "(" in span else NONE
    before = text[max(0, a - 40) : a].casefold()
    near = re.findall(r"[^\W_](?:[\w-]*\w)?|§", before)[-4:]
    context = YES if any(w in NEAR[KINDS[kind]] for w in near) else NO if near and near[-1] in FAR else NONE
    left, right = text[a - 1 : a], text[b : b + 1]
    touch = NO if left.isalnum() or right.isalnum() or left and left in "#$€£=/\\_" else YES
    return form, valid, listed, context, touch


def _secret_votes(text: str, a: int, b: int) -> tuple[int, ...]:
    """Randomness, assignment, gazetteers of prefixes and of public names, the words before, quotes."""
    span = text[a:b]
    parts = [p for p in re.split(r"[+/_=~.-]+", span) if p]
    wordy = len(parts) > 1 and sum(p.isalpha() and len(p) < 12 for p in parts) * 2 > len(parts)
    counts = np.unique(np.frombuffer(span.encode()[:512], np.uint8), return_counts=True)[1] / min(len(span.encode()), 512)
    spread = float(-(counts * np.log2(counts)).sum())
    known = KEY.match(span) is not None
    form = YES if known or not wordy and spread >= 3 and len(digits(span)) * 20 >= len(span) else NO if wordy or spread < 2.5 else NONE
    valid = YES if re.search(r"(?:=>|[=:])\s{0,4}[\"']?$", text[max(0, a - 8) : a]) else NONE
    near = re.findall(r"[^\W_](?:[\w-]*\w)?", text[max(0, a - 48) : a].casefold())[-3:]
    public = any(w in PUBLIC for w in near)
    listed = YES if known else NO if wordy or public or re.search(r"\.(?:com|org|net|html?|php|png|jpe?g|pdf)$", span, re.I) else NONE
    context = YES if any(w in NEAR["secret"] or re.search(_NAMES, w) for w in near) else NO if public else NONE
    left, right = text[a - 1 : a], text[b : b + 1]
    touch = YES if left and left in "\"'" and right and right in "\"'" else NO if left and left in "#$@/" else NONE
    return form, valid, listed, context, touch


LABELERS = 5
PATTERNS = len(KINDS) * 3**LABELERS * 4
#: Pseudo-votes no, yes and nothing that each labeler has cast on true and on false candidates.
FOR_TRUE, FOR_FALSE = np.array([1.0, 3.0, 1.0]), np.array([3.0, 1.0, 1.0])


def coded(kind: int, marks: tuple[int, ...], length: int) -> int:
    """Kind, votes and length class as one number below PATTERNS."""
    code = kind
    for v in marks:
        code = code * 3 + v
    return code * 4 + (0 if length < 12 else 1 if length < 18 else 2 if length < 30 else 3)


def decoded(code: int) -> tuple[int, tuple[int, ...], int]:
    code, length = divmod(code, 4)
    marks = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        marks.append(v)
    return code, tuple(reversed(marks)), length


def reliabilities(marks: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Probability that each vote pattern of one kind is true, by EM over two classes (Dawid and Skene's model)."""
    lean = (marks == YES).sum(1) - (marks == NO).sum(1)
    p = stats.sigmoid(1.5 * (lean - 0.5))
    total = counts.sum()
    for _ in range(rounds):
        log = []
        # a prior of a few pseudo-votes keeps a labeler that never errs from deciding alone, and keeps the classes' sides
        for weight, prior in ((p * counts, FOR_TRUE), ((1 - p) * counts, FOR_FALSE)):
            sure = np.log((weight.sum() + 1) / (total + 2)) + np.zeros(len(p))
            for j in range(LABELERS):
                seen = np.bincount(marks[:, j], weights=weight, minlength=3) + prior
                sure += np.log(seen / seen.sum())[marks[:, j]]
            log.append(sure)
        p = stats.sigmoid(log[0] - log[1])
    return p


def accepted(table: dict[int, int]) -> list[int]:
    """Codes that the span classifier accepts, from the count of each code over all documents."""
    if not table:
        return []
    codes = sorted(table)
    parsed = [decoded(c) for c in codes]
    kind = np.array([k for k, _, _ in parsed])
    marks = np.array([m for _, m, _ in parsed])
    length = np.array([n for _, _, n in parsed])
    counts = np.array([table[c] for c in codes], float)
    truth = np.zeros(len(codes))
    for k in set(kind.tolist()):
        own = kind == k
        # patterns that differ in length alone are one to the labelers
        keys, back = np.unique(marks[own], axis=0, return_inverse=True)
        truth[own] = reliabilities(keys, np.bincount(back.ravel(), weights=counts[own]))[back.ravel()]
    columns = [np.ones(len(codes)), *(kind == k for k in range(len(KINDS))), *(length == n for n in range(4))]
    columns += [(marks[:, j] == v) & (kind == k) for j in range(LABELERS) for v in (YES, NO) for k in range(len(KINDS))]
    design = np.column_stack(columns).astype(float)
    weights = stats.logistic(design, truth, counts / counts.sum() * 1000, 0.05)
    sure = stats.sigmoid(design @ weights)
    return [c for c, s in zip(codes, sure, strict=True) if s >= 0.5]


def _found(text: str) -> tuple[list[list[Span]], list[tuple[int, Span, int]], list[int]]:
    """Base spans, further candidates with their codes, and the codes of all."""
    base = base_spans(text)
    codes = [coded(k, votes(k, text, a, b), b - a) for k, spans in enumerate(base) for a, b in spans]
    more = [(k, s, coded(k, votes(k, text, *s), s[1] - s[0])) for k, s in wider(text, base)]
    return base, more, codes + [c for _, _, c in more]


def _joined(base: list[list[Span]], more: list[tuple[int, Span, int]], yes: frozenset[int]) -> list[tuple[int, int, int]]:
    """All spans by kind and start: base ones and accepted candidates, of which earlier kinds come first where two overlap."""
    out = [(k, a, b) for k, spans in enumerate(base) for a, b in spans]
    added: list[Span] = []
    for k, (a, b), code in more:
        if code in yes and all(b <= c or d <= a for c, d in added):
            added.append((a, b))
            out.append((k, a, b))
    return sorted(out)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_spans) of every row.

    n_email to n_phone count base spans, n_added what the method adds, n_secret the secrets of these, n_spans all.  Candidates of all rows are written once to the shared checkpoint
    folder, without the texts; the vote counts and then the result are made from there.
    """

    def run(batches):
        for batch in batches:
            base, more, codes = [], [], []
            for _, texts in kernels.text_lists(batch.column(1)):
                for text in texts:
                    b, m, c = _found(text)
                    base.append(b)
                    more.append(";".join(f"{k}:{s[0]}:{s[1]}:{code}" for k, s, code in m))
                    codes.append(c)
            written = [_written([(k, x, y) for k, spans in enumerate(b) for x, y in spans]) for b in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([len(b[k]) for b in base], pa.int64()) for k in range(4)), pa.array([hashlib.sha256(w.encode()).hexdigest() for w in written]), pa.array(written), pa.array(more), pa.array(codes, pa.list_(pa.int32()))],
                ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "base", "more", "codes"],
            )

    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    found = cut(mapped(pick(documents, **{id_col: "long", text_col: "string"}), run, f"doc_id long, {counts}, base_sha256 string, base string, more string, codes array<int>"))
    yes = frozenset(accepted({r["code"]: r["n"] for r in found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}))

    def finish(batches):
        for batch in batches:
            base, more = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            spans, added, secret, total = [], [], [], []
            for b, m in zip(base, more, strict=True):
                if not m:
                    spans.append(b)
                    added.append(0)
                    secret.append(0)
                    total.append(b.count(",") + 1 if b else 0)
                    continue
                own: list[list[Span]] = [[] for _ in KINDS]
                for x in filter(None, b.split(",")):
                    kind, i, j = x.split(":")
                    own[KINDS.index(kind)].append((int(i), int(j)))
                extra = [(k, (i, j), c) for k, i, j, c in (map(int, x.split(":")) for x in m.split(";"))]
                every = _joined(own, extra, yes)
                spans.append(_written(every))
                added.append(len(every) - sum(map(len, own)))
                secret.append(sum(k == 4 for k, _, _ in every))
                total.append(len(every))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(spans, pa.string()), *(pa.array(x, pa.int64()) for x in (added, secret, total))], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    return mapped(found, finish, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long, n_secret long, n_spans long")


def learn(documents: DataFrame, text_col: str = "text") -> frozenset[int]:
    """The codes to accept, from the vote counts of all documents."""

    def run(batches):
        counts: dict[int, int] = {}
        for batch in batches:
            for _, texts in kernels.text_lists(batch.column(0)):
                for text in texts:
                    for code in _found(text)[2]:
                        counts[code] = counts.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], ["code", "n"])

    rows = mapped(pick(documents, **{text_col: "string"}), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # at most PATTERNS rows
    return frozenset(accepted({r["code"]: r["n"] for r in rows}))


def masked(text: str, yes: frozenset[int]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping base spans are one, of the earlier kind."""
    base, more, _ = _found(text)
    out, last = [], 0
    for k, a, b in sorted(_joined(base, more, yes), key=lambda s: (s[1], s[0])):
        if a >= last:
            out += text[last:a], f"[{KINDS[k].upper()}]"
        last = max(last, b)
    return "".join([*out, text[last:]]) if out else text


def mask(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, personal data in the text masked and the number of characters set anew; null texts stay null."""
    yes = learn(documents, text_col)
    names = documents.columns
    place, chars = names.index(text_col), names.index(chars_col) if chars_col in names else -1

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            texts = [None if t is None else masked(t, yes) for t in columns[place].to_pylist()]
            columns[place] = pa.array(texts, columns[place].type)
            if chars >= 0:
                old = columns[chars]
                columns[chars] = pa.array([o if t is None else len(t) for t, o in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(documents, run, documents.schema)
