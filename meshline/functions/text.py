"""Text of annotations: character sets, vertical forms, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but kana, ideographs and compatibility ideographs.
NOT_JAPANESE = "[^\\u3040-\\u30ff\\u3400-\\u9fff\\uf900-\\ufaff]"
LONG_VOWEL, LONG_VOWEL_UPRIGHT = "ー", "︱"
CODECS = {"shift_jis": "cp932", "sjis": "cp932", "windows-31j": "cp932", "euc-jp": "euc_jp", "utf-8": "utf-8"}


def japanese_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_JAPANESE, ""))


def vertical_text(text: Column) -> Column:
    """The text with upright long-vowel marks; null where it has none."""
    changed = F.replace(text, F.lit(LONG_VOWEL), F.lit(LONG_VOWEL_UPRIGHT))
    return F.nullif(changed, text)


def _decode_one(raw: bytes, kind: int, codec: str) -> str:
    if kind == 1 and len(raw) % 2 == 0 and all(0x21 <= b <= 0x7E for b in raw):
        # Seven-bit JIS X 0208: the same code points in EUC-JP have the high bits set.
        try:
            text = bytes(b | 0x80 for b in raw).decode("euc_jp")
        except UnicodeDecodeError:
            text = ""
        if any(0x3040 <= ord(c) <= 0x30FF or 0x3400 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF for c in text):
            return text
    return raw.decode(codec, errors="replace")


def decode_annotation(raw: Column, kind: Column, encoding: str = "shift_jis") -> Column:
    """Annotation bytes as text; type 1 may be seven-bit JIS. Spark has no decoder for these character sets."""
    codec = CODECS.get(encoding.lower(), encoding)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, kinds in batches:
            yield pd.Series([None if r is None else _decode_one(bytes(r), int(k) if k == k and k is not None else 2, codec) for r, k in zip(raws, kinds, strict=True)], dtype=object)

    return run(raw, kind)


def annotation_bytes(rows: Column, count: Column, kind: Column) -> Column:
    """The text bytes of an annotation's rows: columns 20 to 84 of each, together, as many as the header says (twice for type 1)."""
    parts = F.transform(rows, lambda r: F.substring(r, 21, 64))
    need = F.when(kind == 1, count * 2).otherwise(count).cast("int")
    return F.encode(F.substr(F.array_join(parts, ""), F.lit(1), F.greatest(need, F.lit(0))), "ISO-8859-1")


def attribute_bytes(rows: Column) -> Column:
    return F.encode(F.array_join(F.transform(rows, lambda r: F.substring(r, 1, 84)), ""), "ISO-8859-1")


def trimmed_or_null(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"^[\s　]+|[\s　]+$", ""), F.lit(""))
