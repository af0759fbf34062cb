"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores (operator 3)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.textcore import map_texts
from quillstack.session import table

#: Kinds in the order of a span list; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

# A digit run can't be entered in the middle, so the look-behinds change no match; they keep long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in range(15, 35)}
_IBAN_RUN = re.compile(r"(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by its country; other codes take the whole run of groups.
IBAN_LENGTH = {
    code: int(length)
    for length, codes in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL"
        " 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for code in codes.split(",")
}

#: Score of a confirmed span, and words that raise it when they stand among the CONTEXT code points before or after it.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT, RAISE = 48, 0.15
WORDS = {
    "email": "mail email e-mail contact reach write address correo contacto escriba courriel contacter écrire kontakt schreiben",
    "ip": "ip ipv4 address host hostname server client gateway router adresse adresa dirección servidor serveur rechner",
    "card": "card visa mastercard amex credit debit payment pay expires cvv cvc tarjeta crédito pago carte crédit paiement karte kreditkarte zahlung",
    "phone": "phone telephone call tel mobile cell fax dial whatsapp sms teléfono móvil llame llamar téléphone portable appeler telefon handy anrufen rufnummer",
    "iban": "iban account bank transfer bic swift cuenta banco transferencia compte banque virement konto bankverbindung überweisung",
}
_NEAR = {kind: re.compile(rf"\b(?:{'|'.join(map(re.escape, words.split()))})s?\b") for kind, words in WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(t: str):
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and t[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = t.find("@", max(at + 1, end))


def _ibans(t: str):
    """What follows an IBAN (a BIC, a currency, a year) may look like more of it, so its country tells where it ends."""
    end = 0
    for m in _IBAN.finditer(t):
        if m.start() < end:
            continue
        length = IBAN_LENGTH.get(m[0][:2])
        rest = (_IBAN_REST[length] if length else _IBAN_RUN).match(t, m.end())
        if rest and mod97(t[m.start() : rest.end()].replace(" ", "")):
            end = rest.end()
            yield m.start(), end


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind. Matches that fail their check go."""
    found = [("email", a, b) for a, b in _emails(t)] if "@" in t else []
    for m in _IP.finditer(t):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", a, b) for a, b in _ibans(t)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def score(t: str, kind: str, start: int, end: int) -> float:
    """Of the kind, raised by a whole word (or its plural) of the kind's on either side."""
    near = f"{t[max(0, start - CONTEXT) : start]}\n{t[end : end + CONTEXT]}".lower()
    return min(1.0, SCORE[kind] + RAISE * bool(_NEAR[kind].search(near)))


def _find(batch: pa.RecordBatch) -> list:
    out = []
    for t in batch.column(batch.num_columns - 1).to_pylist():
        out.append([{"kind": k, "start": a, "end": b, "score": score(t, k, a, b)} for k, a, b in find_spans(t)])
    return [out]


def find_pii(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with spans array<struct<kind, start, end, score>>, by start and then kind.

    Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans; equal rows have
    equal results; texts of any length are searched whole; an empty table stays empty. A column named spans, in either
    case, gives way to the new one.
    """
    out = "spans array<struct<kind: string, start: long, end: long, score: double>>"
    return map_texts(docs, text, list(docs.columns if keep is None else keep), out, lambda: _find)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scores(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.format_string("%.2f", s["score"])), ",")


def kind_is(kind: str):
    return lambda span: span["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores(F.col("spans")).alias("scores"))
