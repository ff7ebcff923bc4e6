"""Text encodings by the labels that the web gives them; decoding in Arrow batches where Spark has no decoder."""

from __future__ import annotations

import codecs
from encodings.aliases import aliases

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The web's encodings and the standard library's codecs for them.
CODECS = {
    "ibm866": "cp866", "iso-8859-2": "iso8859-2", "iso-8859-3": "iso8859-3", "iso-8859-4": "iso8859-4", "iso-8859-5": "iso8859-5", "iso-8859-6": "iso8859-6",
    "iso-8859-7": "iso8859-7", "iso-8859-8": "iso8859-8", "iso-8859-10": "iso8859-10", "iso-8859-13": "iso8859-13", "iso-8859-14": "iso8859-14", "iso-8859-15": "iso8859-15",
    "iso-8859-16": "iso8859-16", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "macintosh": "mac-roman", "windows-874": "cp874", "windows-1250": "cp1250", "windows-1251": "cp1251",
    "windows-1252": "cp1252", "windows-1253": "cp1253", "windows-1254": "cp1254", "windows-1255": "cp1255", "windows-1256": "cp1256", "windows-1257": "cp1257",
    "windows-1258": "cp1258", "x-mac-cyrillic": "mac-cyrillic", "gbk": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp",
    "shift_jis": "cp932", "euc-kr": "cp949", "utf-16be": "utf-16-be", "utf-16le": "utf-16-le",
}
# Encodings that the web reads as a larger one, and labels that the standard library doesn't know.
WIDENED = {"ascii": "windows-1252", "iso8859-1": "windows-1252", "iso8859-9": "windows-1254", "iso8859-11": "windows-874", "tis-620": "windows-874", "gb2312": "gbk", "gbk": "gbk", "euc_kr": "euc-kr", "shift_jis": "shift_jis", "big5": "big5", "utf-16": "utf-16le"}
LABELS = {"unicode-1-1-utf-8": "utf-8", "x-cp1250": "windows-1250", "x-cp1251": "windows-1251", "x-cp1252": "windows-1252", "x-sjis": "shift_jis", "x-gbk": "gbk", "ucs-2": "utf-16le", "x-euc-jp": "euc-jp", "ks_c_5601-1987": "euc-kr", "x-x-big5": "big5", "dos-874": "windows-874", "koi": "koi8-r", "mac": "macintosh"}


def _labels() -> dict[str, str]:
    """Every label by rule: the web's names, and the standard library's aliases in all spellings, mapped to the web's name of what they mean."""
    of = {codecs.lookup(codec).name: web for web, codec in CODECS.items() if web != "gbk"} | {codecs.lookup(k).name: v for k, v in WIDENED.items()} | {"utf-8": "utf-8"}
    out = {}
    for alias in {*aliases, *aliases.values(), *of}:
        try:
            web = of.get(codecs.lookup(alias).name)
        except LookupError:
            continue
        if web and not alias.isdigit():
            out |= {alias: web, alias.replace("_", "-"): web}
            if alias.startswith("iso8859"):
                out |= {dash + alias.replace("_", "-")[7:]: web for dash in ("iso-8859", "iso_8859")}
    return out | {"utf-8": "utf-8", "utf8": "utf-8"} | {name: name for name in CODECS} | LABELS


NAMES = _labels()


def _lost(error: UnicodeError):
    """Bytes of the C1 range that a Windows code page leaves open stand for themselves; others are replaced."""
    data = error.object[error.start : error.start + 1]
    return (chr(data[0]) if 0x80 <= data[0] <= 0x9F else "\ufffd", error.start + 1)


def canonical(label: Column) -> Column:
    """The web's name for a label; one that isn't known is itself in lower case."""
    low = F.lower(F.trim(label))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(NAMES.items()) for x in pair])[low], low)


@F.pandas_udf(StringType())
def _decoded(body: pd.Series, name: pd.Series) -> pd.Series:
    codecs.register_error("web", _lost)

    def one(data, web: str):
        if data is None:
            return None
        data = bytes(data)
        for mark, codec in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
            if data.startswith(mark):
                return data[len(mark) :].decode(codec, "replace")
        codec = CODECS[web]
        return data.decode(codec, "web" if codec.startswith("cp125") else "replace")

    return pd.Series([one(b, n) for b, n in zip(body, name)], dtype=object)


# What windows-1252 has where Latin-1 has control characters; bytes that it leaves open stand for themselves.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0))
#: UTF-16 by bytes: any units but surrogates and U+FFFE, which Spark's decoder refuses, and surrogates in pairs. Possessive, so that long texts need no stack.
_PAIRS = {"utf-16le": r"(?s)\A(?:(?!\xFE\xFF).[^\xD8-\xDF]|.[\xD8-\xDB].[\xDC-\xDF])*+\z", "utf-16be": r"(?s)\A(?:(?!\xFF\xFE)[^\xD8-\xDF].|[\xD8-\xDB].[\xDC-\xDF].)*+\z"}


def decoded(body: Column, charset: Column) -> Column:
    """Bytes as text by a canonical charset. A byte-order mark overrides it and goes; null and unknown charsets are UTF-8; what isn't valid becomes replacement characters.

    UTF-8, windows-1252 and valid UTF-16 stay inside Spark, row by row: only bodies in other encodings are sent to Python.
    """
    first = F.hex(F.substring(body, 1, 2))
    known = F.coalesce(charset.isin(*CODECS), F.lit(False))
    name = F.when(F.hex(F.substring(body, 1, 3)) == "EFBBBF", "utf-8").when(first == "FEFF", "utf-16be").when(first == "FFFE", "utf-16le").when(known, charset).otherwise("utf-8")
    by_byte = F.decode(body, "ISO-8859-1")
    valid = F.lit(False)
    for wide, pairs in _PAIRS.items():
        valid = F.when(name == wide, by_byte.rlike(pairs)).otherwise(valid)
    how = F.when(name.isin("utf-8", "windows-1252"), name).when(F.coalesce(valid, F.lit(True)), name).otherwise("python")
    # null where another encoding is meant, so that neither decoder nor Python sees bytes that aren't its own
    own = lambda h, k: F.when(h == k, body)

    def inside(h: Column) -> Column:
        wide = F.coalesce(*[F.decode(own(h, k), k.upper()) for k in _PAIRS])
        plain = F.make_valid_utf8(own(h, "utf-8").cast("string"))
        narrow = F.translate(F.decode(own(h, "windows-1252"), "ISO-8859-1"), _C1, _WINDOWS)
        return F.coalesce(narrow, F.regexp_replace(F.coalesce(wide, plain), "^\\x{FEFF}", ""))

    text = F.element_at(F.transform(F.array(how), inside), 1)
    return F.coalesce(text, _decoded(own(how, "python"), F.when(how == "python", F.when(known, charset).otherwise("utf-16le"))))
