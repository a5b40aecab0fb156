"""Decoder of broadcast strings (ARIB STD-B24, 8-bit codes) as an Arrow-batched function.

Four sets are designated to G0 to G3 by escape sequences and invoked on the left and right half by locking shifts, or for one character
by single shifts. Two-byte kanji are read as JIS X 0208, rows 85 and beyond as additional symbols; kana, alphanumerics and their proportional forms as one byte; glyphs sent with the
stream (DRCS) through a map, with a placeholder where it lacks one. Format codes set size, colour and position of what follows. What a
broken or cut-off sequence leaves is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KANJI, ALNUM, HIRAGANA, KATAKANA, MOSAIC, DRCS, MACRO, SYMBOL = "kanji alnum hiragana katakana mosaic drcs macro symbol".split()
PLACEHOLDER = "□"
# Final bytes that designate one- and two-byte sets, and the sets of one-byte glyphs DRCS-1 to DRCS-15.
ONE_BYTE = {0x4A: ALNUM, 0x36: ALNUM, 0x30: HIRAGANA, 0x37: HIRAGANA, 0x31: KATAKANA, 0x38: KATAKANA, 0x32: MOSAIC, 0x33: MOSAIC, 0x34: MOSAIC, 0x35: MOSAIC, 0x49: KATAKANA}
TWO_BYTE = {0x42: KANJI, 0x39: KANJI, 0x3A: KANJI, 0x3B: SYMBOL}
# The last seven kana of a one-byte set, and the alphanumeric marks that differ from ASCII.
KANA_TAIL = {0x77: ("ゝ", "ヽ"), 0x78: ("ゞ", "ヾ"), 0x79: ("ー", "ー"), 0x7A: ("。", "。"), 0x7B: ("「", "「"), 0x7C: ("」", "」"), 0x7D: ("、", "、"), 0x7E: ("・", "・")}
ALNUM_MARKS = {0x5C: "¥", 0x7E: "‾"}
# How many parameter bytes follow each format code (control bytes of both halves).
PARAMETERS = {0x16: 1, 0x1C: 2, 0x8B: 1, 0x90: 1, 0x91: 1, 0x93: 1, 0x94: 1, 0x97: 1, 0x98: 1}
SIZES = {0x88: "small", 0x89: "middle", 0x8A: "normal"}
COLOURS = dict(zip(range(0x80, 0x88), "black red green yellow blue magenta cyan white".split(), strict=True))

# Additional symbols by the code of the first of each run; those that follow a rule are made below. `symbols` gives others.
_SYMBOL_RUNS = {
    0x7A50: "[HV] [SD] [Ｐ] [Ｗ] [MV] [手] [字] [双] [デ] [Ｓ] [二] [多] [解] [SS] [Ｂ] [Ｎ] ■ ● [天] [交] [映] [無] [料] [年齢制限] [前] [後] [再] [新] [初] [終] [生] [販] [声] [吹] [PPV] (秘) ほか",
    0x7C21: "→ ← ↑ ↓ ○ ● 年 月 日 円 ㎡ ㎥ ㎝ ㎠ ㎤",
    0x7C3A: "氏 副 元 故 前 新",
    0x7C4A: "(社) (財) (有) (株) (代) (問) ▶ ◀ 〖 〗 ◇",
    0x7D29: "㍾ ㍽ ㍼ ㍻ № ℡ (〒) ○ 〔本〕 〔三〕 〔二〕 〔安〕 〔点〕 〔打〕 〔盗〕 〔勝〕 〔敗〕 〔Ｓ〕 ［投］ ［捕］ ［一］ ［二］ ［三］ ［遊］ ［左］ ［中］ ［右］ ［指］ ［走］ ［打］",
    0x7D60: "☀ ☁ ☂ ☃",
    0x7E2B: "XI XⅡ",
}
#: Runs of symbols that are numbered in Unicode as well: code of the first, how many, its code point.
_SYMBOL_RANGES = [
    (0x7C31, 9, 0x2488), (0x7D21, 7, 0x322A), (0x7D28, 1, 0x3237), (0x7E21, 10, 0x2160), (0x7E2D, 4, 0x2470), (0x7E31, 12, 0x2474), (0x7E3D, 4, 0x3251), (0x7E5B, 6, 0x3255), (0x7E61, 16, 0x2460),
    (0x7E71, 10, 0x2776), (0x7E7B, 2, 0x24EB), (0x7E7D, 1, 0x325B),
]


def _symbol_table() -> dict[int, str]:
    out = {first + k: text for first, texts in _SYMBOL_RUNS.items() for k, text in enumerate(texts.split(" "))}
    out |= {first + k: chr(point + k) for first, n, point in _SYMBOL_RANGES for k in range(n)}
    out |= {0x7C30: "０."} | {0x7C40 + k: chr(0xFF10 + k) + "," for k in range(10)}
    return out | {0x7E41 + k: f"({chr(0x41 + k)})" for k in range(26)}


SYMBOLS = _symbol_table()
#: Codes from here on are no kanji but symbols.
FIRST_SYMBOL = 0x7521


def _one(kind: str, code: int) -> str:
    if kind == ALNUM:
        return ALNUM_MARKS.get(code, chr(code))
    if kind in (HIRAGANA, KATAKANA):
        if code in KANA_TAIL:
            return KANA_TAIL[code][kind == KATAKANA]
        last = 0x73 if kind == HIRAGANA else 0x76
        return chr((0x3041 if kind == HIRAGANA else 0x30A1) + code - 0x21) if 0x21 <= code <= last else ""
    return ""


def _two(kind: str, first: int, second: int, symbols: dict[int, str]) -> str:
    code = first << 8 | second
    if kind == SYMBOL or code >= FIRST_SYMBOL:
        return symbols.get(code) or SYMBOLS.get(code, PLACEHOLDER)
    if kind == KANJI:
        try:
            return bytes((0x1B, 0x24, 0x42, first, second, 0x1B, 0x28, 0x42)).decode("iso2022_jp")
        except UnicodeDecodeError:
            pass
    return "〓"


def decode(data: bytes, caption: bool = False, glyphs: dict[str, str] | None = None, symbols: dict[int, str] | None = None) -> list[dict]:
    """Runs of text that share a format: text, size, colour and position (row, column of the last positioning). symbols: texts of two-byte symbols, before those known here."""
    sets = [KANJI, ALNUM, HIRAGANA, MACRO if caption else KATAKANA]
    left, right = 0, 2
    style = {"size": "normal", "colour": "white", "row": None, "col": None}
    runs: list[dict] = []
    single: int | None = None
    repeat, i = 1, 0

    def put(text: str) -> None:
        nonlocal repeat
        text, repeat = text * repeat, 1
        if text:
            if runs and all(runs[-1][k] == v for k, v in style.items()):
                runs[-1]["text"] += text
            else:
                runs.append({"text": text, **style})

    while i < len(data):
        b = data[i]
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFE:
            kind = sets[single if single is not None else right if b & 0x80 else left]
            single = None
            code = b & 0x7F
            if kind in (KANJI, SYMBOL, DRCS + "2"):
                if i + 1 >= len(data):
                    break
                second = data[i + 1] & 0x7F
                put((glyphs or {}).get(f"{code:02x}{second:02x}", PLACEHOLDER) if kind == DRCS + "2" else _two(kind, code, second, symbols or {}))
                i += 2
                continue
            if kind.startswith(DRCS):
                put((glyphs or {}).get(f"{kind[len(DRCS) :]}{code:02x}", PLACEHOLDER))
            elif kind == MACRO:
                if code in (0x60, 0x61, 0x62):  # the standard macros designate their sets anew
                    sets = [[KANJI, ALNUM, HIRAGANA, MACRO], [KANJI, KATAKANA, HIRAGANA, MACRO], [KANJI, DRCS + "1", HIRAGANA, MACRO]][code - 0x60]
                    left, right = 0, 2
            else:
                put(_one(kind, code))
            i += 1
            continue
        i += 1
        if b == 0x1B:
            at = i
            while i < len(data) and data[i] in (0x24, 0x28, 0x29, 0x2A, 0x2B, 0x20):
                i += 1
            if i >= len(data):
                break
            marks, final = data[at:i], data[i]
            i += 1
            place = next((m - 0x28 for m in marks if 0x28 <= m <= 0x2B), 0)
            if not marks:
                shift = {0x6E: ("l", 2), 0x6F: ("l", 3), 0x7E: ("r", 1), 0x7D: ("r", 2), 0x7C: ("r", 3)}.get(final)
                if shift:
                    left, right = (shift[1], right) if shift[0] == "l" else (left, shift[1])
            elif 0x20 in marks:
                sets[place] = DRCS + "2" if final == 0x40 else MACRO if final == 0x70 else f"{DRCS}{final - 0x40:x}"
            elif 0x24 in marks:
                sets[place] = TWO_BYTE.get(final, SYMBOL)
            else:
                sets[place] = ONE_BYTE.get(final, ALNUM)
        elif b in (0x0E, 0x0F):
            left = 1 if b == 0x0E else 0
        elif b in (0x19, 0x1D):
            single = 2 if b == 0x19 else 3
        elif b in (0x20, 0xA0):
            put(" " if style["size"] == "middle" else "　")
        elif b == 0x0D:
            put("\n")
        elif b in SIZES:
            style["size"] = SIZES[b]
        elif b in COLOURS:
            style["colour"] = COLOURS[b]
        elif b == 0x98 and i < len(data):
            repeat = max(1, (data[i] & 0x3F))
            i += 1
        elif b == 0x1C and i + 1 < len(data):
            style["row"], style["col"] = data[i] & 0x3F, data[i + 1] & 0x3F
            i += 2
        elif b == 0x9B:  # control sequence: parameters up to its final byte
            while i < len(data) and not 0x40 <= data[i] <= 0x7E:
                i += 1
            i += 1
        elif b == 0x9D:
            i += 2 if i < len(data) and data[i] in (0x20, 0x28) else 1
        else:
            i += PARAMETERS.get(b, 0)
    return runs


def decoded(data: Column, caption: bool = False, glyphs: dict[str, str] | None = None, symbols: dict[int, str] | None = None) -> Column:
    """An array of (text, size, colour, row, col); an empty one for null."""

    @F.pandas_udf("array<struct<text:string,size:string,colour:string,row:int,col:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda x: decode(bytes(x), caption, glyphs, symbols) if x is not None else [])

    return run(data)
