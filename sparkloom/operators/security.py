"""Scanning of untrusted text: redaction, injection, cards, entropy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# What is redacted, by name, in order.
SECRETS = {
    "generic-assignment": r"(?i)\b(api[_-]?key|access[_-]?token|authorization|password|passwd|secret|bearer|private[_-]?key|client[_-]?secret|session[_-]?id|cookie)\b\s*[:=]\s*([^\s,;]+)",
    "aws-access-key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github-token": r"\b(?:gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{20,255})\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "database-uri": r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s]+",
    "private-key": r"(?s)-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----.*?-----END(?: [A-Z0-9]+)? PRIVATE KEY-----",
}
# Card numbers, addresses, tokens of high entropy, and encoded payloads.
CARD = r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
# Phrases that try to instruct the reader, by group of languages.
INJECTIONS = [
    r"(?is)(ignore\s+(?:all\s+)?(?:previous|prior)\s+instructions|do\s+not\s+follow\s+(?:the\s+)?(?:system|developer)|reveal\s+(?:the\s+)?(?:system\s+)?prompt|you\s+are\s+(?:chatgpt|an?\s+assistant)|<\/?(?:system|assistant|developer|tool)>|system\s+message\s*:|developer\s+message\s*:)",
    r"(?is)(önceki\s+(?:tüm\s+)?talimatları\s+(?:yoksay|unut)|sistem\s+istemini\s+(?:göster|açıkla)|geliştirici\s+mesajını\s+(?:göster|ifşa\s+et))",
    r"(?is)(ignora\s+(?:todas\s+)?las\s+instrucciones\s+anteriores|忽略(?:之前|所有).*指令|以前の指示を.*無視)",
]
HIGH_ENTROPY = r"(?<![A-Za-z0-9])[A-Za-z0-9_\-+/=]{24,}(?![A-Za-z0-9])"
ENTROPY_BITS, ENTROPY_CHARS = 4.2, 10
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_-])")
HEX = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}(?![0-9a-fA-F])")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){8,}")
#: Code points of payloads that one batch holds, unless one has more.
PAYLOADS = 1 << 20


def valid_card(text: Column) -> Column:
    """13 to 19 digits, not all equal, with a Luhn sum."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & (F.size(F.array_distinct(F.split(digits, ""))) > 1) & F.call_function("luhn_check", digits)


def cards(text: Column) -> Column:
    """Card numbers that pass the check."""
    return F.filter(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), valid_card)


#: Signs of which a match has at least one: a search for them is far cheaper than the pattern.
SIGNS = {"generic-assignment": ":=", "aws-access-key": ["AKIA", "ASIA"], "github-token": "_", "jwt": ["eyJ"], "database-uri": ["://"], "private-key": ["-----BEGIN"], "email": "@"}


def _replaced(text: Column, signs, pattern: str, by: str) -> Column:
    def step(t: Column) -> Column:
        some = reduce(lambda a, b: a | b, [F.contains(t, F.lit(s)) for s in signs])
        return F.when(some, F.regexp_replace(t, pattern, by)).otherwise(t)

    return tx.let(text, step)


def redacted(text: Column) -> Column:
    """Secrets, valid card numbers and addresses replaced by their names in brackets; each card is held against its check on its own."""
    out = text
    for name, pattern in SECRETS.items():
        out = _replaced(out, SIGNS[name], pattern, "$1=[redacted:generic-assignment]" if name == "generic-assignment" else f"[redacted:{name}]")
    out = tx.let(out, lambda t: F.aggregate(F.transform(cards(t), lambda x: F.trim(x)), t, lambda s, c: F.replace(s, c, F.lit("[redacted:payment-card]"))))
    return _replaced(out, SIGNS["email"], EMAIL, "[redacted:email]")


def secret_types(text: Column) -> Column:
    hits = [F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def injection_reasons(text: Column) -> Column:
    """Which groups match as written, or after look-alike letters are folded."""
    def of(plain: Column, folded: Column) -> Column:
        hits = [F.when(plain.rlike(p), F.lit(f"direct-pattern-{i}")).when(folded.rlike(p), F.lit(f"confusable-pattern-{i}")) for i, p in enumerate(INJECTIONS, 1)]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    # Both forms are made once a text; the folded one only where there is a letter to fold.
    folded = lambda plain: F.when(plain.rlike(f"[{tx.CONFUSABLE}]"), tx.skeleton(plain))
    return tx.let(tx.strip_ansi(text), lambda plain: tx.let(folded(plain), lambda f: of(plain, f)))


def high_entropy_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(HIGH_ENTROPY), F.lit(0))
    return F.filter(found, lambda t: (F.size(F.array_distinct(F.split(t, ""))) >= ENTROPY_CHARS) & (tx.shannon_entropy(t) >= ENTROPY_BITS))


def payloads(text: str) -> Iterator[str]:
    """What base64, hexadecimal and percent escapes in a text say: every match, whole, one at a time; those that aren't UTF-8 are left out."""
    import base64
    from urllib.parse import unquote_to_bytes

    for pattern, decode in ((BASE64, lambda x: base64.urlsafe_b64decode(x.replace("+", "-").replace("/", "_").rstrip("=") + "=" * (-len(x.rstrip("=")) % 4))), (HEX, lambda x: bytes.fromhex(x[: len(x) // 2 * 2])), (PERCENT, unquote_to_bytes)):
        for m in pattern.finditer(text):
            try:
                yield decode(m[0]).decode("utf-8")
            except ValueError:  # also what isn't UTF-8
                continue


def decoded_payloads(text: str) -> list[str]:
    """All payloads of a text."""
    return list(payloads(text))


def decompressed(data: bytes, piece: int = 1 << 20, overlap: int = 8192) -> Iterator[bytes]:
    """What gzip or zlib data holds, whole, all gzip members in turn, in pieces of at most `piece` bytes that begin with the last `overlap` bytes before them, so that
    matches over the seams are found and memory stays bounded; nothing for other data. Data that breaks off, or goes on with something else, gives what it holds."""
    tail = b""
    for bits, magic in ((31, b"\x1f\x8b"), (15, b"\x78")):
        rest, some = data, False
        while rest.startswith(magic):
            stream = zlib.decompressobj(bits)
            try:
                while rest and not stream.eof:
                    part = stream.decompress(rest, piece)
                    rest = stream.unconsumed_tail
                    if part:
                        some = True
                        yield tail + part
                        tail = (tail + part)[-overlap:]
                    elif not rest:
                        break
            except zlib.error:
                break
            # Another member may follow, behind padding.
            rest = stream.unused_data.lstrip(b"\0") if bits == 31 else b""
        if some:
            return


def scan_encoded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, payload): decoded payloads of a text, a row each, for a second scan. Arrow batches of PAYLOADS code points or one payload; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, held = [], 0
            for k, t in zip(b[key], b[text], strict=True):
                for p in payloads(t or ""):
                    if rows and held + len(p) > PAYLOADS:
                        yield pd.DataFrame(rows, columns=[key, "payload"])
                        rows, held = [], 0
                    rows.append((k, p))
                    held += len(p)
            yield pd.DataFrame(rows, columns=[key, "payload"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, payload string")


def findings(text: Column) -> Column:
    """What a text holds: secret types and injection reasons, as kind:name."""
    tag = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.array_sort(F.concat(tag("secret", secret_types(text)), tag("injection", injection_reasons(text))))


def scan_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, finding, encoded): findings of the texts themselves and, marked encoded, of the payloads decoded from them; once each. Payloads are scanned in the
    same narrow pass as they are decoded; what is shuffled are the findings."""
    plain = df.select(key, F.explode(findings(F.col(text))).alias("finding"), F.lit(False).alias("encoded"))
    inner = scan_encoded(df, key, text).select(key, F.explode(findings(F.col("payload"))).alias("finding"), F.lit(True).alias("encoded"))
    return plain.unionByName(inner).distinct()


def scan_buffers(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, finding): findings in binary buffers: in the bytes as they are, always, and besides in what gzip or zlib data holds, piece by piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, held = [], 0
            for k, raw in zip(f[key], f[data], strict=True):
                raw = bytes(raw) if raw is not None else b""
                for piece in chain([raw], decompressed(raw)):
                    if rows and held + len(piece) > PAYLOADS:
                        yield pd.DataFrame(rows, columns=[key, "payload"])
                        rows, held = [], 0
                    rows.append((k, piece.decode("utf-8", "replace")))
                    held += len(piece)
            yield pd.DataFrame(rows, columns=[key, "payload"])

    texts = df.select(key, data).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, payload string")
    return texts.select(key, F.explode(findings(F.col("payload"))).alias("finding")).distinct()
