"""File names, paths and codes in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names can't have, and the full-width ones that stand for them; the last pair is optional.
FORBIDDEN, FULL_WIDTH = '/:*?"<>|', "／：＊？”＜＞｜"
BACKSLASH, YEN = "\\", "￥"

# Bits of the kinds of output files, by number (main or other) and content.
OUT_KINDS = {"v": 1, "c": 2, "s": 4, "w": 8, "d": 16, "t": 32, "r": 64, "l": 128}
# Fixed value: the grammar of what follows the main name of an output file.
_TAIL = r"(-([0-9]+))?(_div([0-9]+))?(-cm)?(-nicojk-[0-9]+[ST])?(\..+)"


def escaped(name: Column, with_backslash: bool) -> Column:
    return F.translate(name, FORBIDDEN + BACKSLASH * with_backslash, FULL_WIDTH + YEN * with_backslash)


def suffix(n: Column) -> Column:
    """'' for 0, else a dash and the digits of base 27: A to Z for 1 to 26 in the first place, A to [ for 0 to 26 in the others."""
    places = [F.when(n == 0, "")]
    for k in range(7):  # 27^7 is beyond an int
        digits = [F.char(64 + F.floor(n / 27**k).cast("int"))] + [F.char(65 + F.floor(n / 27**j).cast("int") % 27) for j in range(k - 1, -1, -1)]
        places[0] = places[0].when(n < 27 ** (k + 1), F.concat(F.lit("-"), *digits))
    return places[0]


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def tail_kind(tail: Column) -> Column:
    """Bit of the kind of an output file by what follows the main name; null where that isn't such a tail."""
    number = F.coalesce(F.regexp_extract(tail, _TAIL, 2).try_cast("int"), F.lit(0))
    subtitles = F.regexp_extract(tail, _TAIL, 7).isin(".ass", ".srt")
    cuts = F.regexp_extract(tail, _TAIL, 5) != ""
    kind = F.when(subtitles, 4).when(cuts, 2).otherwise(1)
    return F.when(tail.rlike(_TAIL), F.when(number == 0, kind).otherwise(F.shiftleft(kind, 3)))


def wanted_kinds(letters: Column) -> Column:
    """Letters as the sum of their bits; null, '' and 'all' want everything, unknown letters nothing."""
    bits = F.lit(0)
    for letter, bit in OUT_KINDS.items():
        bits = bits.bitwiseOR(F.when(F.contains(letters, F.lit(letter)), bit).otherwise(0))
    return F.when(letters.isNull() | letters.isin("", "all"), 255).otherwise(bits)


def is_hex(text: Column) -> Column:
    return text.rlike("^[0-9A-Fa-f]+$")


def from_hex(text: Column) -> Column:
    """The bytes that hexadecimal digits stand for; anything else is an error."""
    whole = text.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(text.isNull() | whole, F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("no hexadecimal bytes: "), text)).cast("binary"))


def nibbles_swapped(text: Column) -> Column:
    return F.regexp_replace(text, "(.)(.)", "$2$1")


def folded_md5(text: Column) -> Column:
    """The four little-endian words of a text's MD5, combined by exclusive or, as a number below 2^32."""
    digest = F.md5(text)
    word = lambda k: F.conv(F.concat(*[F.substring(digest, 8 * k + 2 * b + 1, 2) for b in (3, 2, 1, 0)]), 16, 10).cast("long")
    return word(0).bitwiseXOR(word(1)).bitwiseXOR(word(2)).bitwiseXOR(word(3))


def exit_code(code: Column) -> Column:
    """Small codes in decimal, others as hexadecimal, negative ones of 32 bits; codes beyond 32 bits show all their digits."""
    whole = code.cast("long")
    unsigned = F.when(whole < 0, whole + (1 << 32)).otherwise(whole)
    return F.when(F.abs(whole) < 65536, code.cast("string")).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(unsigned))))


def flag_mask(flags: Column) -> Column:
    """An array of booleans as a number, the first as the lowest bit."""
    return F.aggregate(F.transform(flags, lambda f, k: F.when(f, F.expr("1")).otherwise(0) * F.pow(F.lit(2), k).cast("int")), F.lit(0), lambda t, x: t + x)


def grouped_numbers(text: Column, size: int, groups: int) -> Column:
    """Numbers out of a text, between line ends and colons, blank ones dropped, as `groups` groups of `size`; null if they are more or fewer, or one isn't a number."""
    parts = F.filter(F.split(text, "\r\n|\r|\n|:"), lambda x: F.trim(x) != "")
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("int"))
    whole = (F.size(numbers) == size * groups) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(whole, F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda k: F.slice(numbers, k * size + 1, size)))


def recording_title(time: Column, event: Column, service: Column, name: Column) -> Column:
    """`time_event _service.ts`, both escaped, where all three are known and the time is after the year 2000 began; else the file's own name."""
    known = time.isNotNull() & (event != "") & (service != "") & (time > F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    title = F.concat(F.date_format(time, "yyyyMMddHHmm"), F.lit("_"), escaped(event, True), F.lit(" _"), escaped(service, True), F.lit(".ts"))
    return F.when(F.coalesce(known, F.lit(False)), title).otherwise(name)


def snapped(start: Column, length: Column) -> list[Column]:
    """The even number at or below a start and the one at or above a length; the end may lie one before where it was."""
    return [F.floor(start / 2) * 2, F.ceil(length / 2) * 2]


def mac_bytes(text: Column) -> Column:
    """Six numbers of a MAC address written with colons or dashes."""
    return F.transform(F.split(text, "[:-]"), lambda x: F.conv(x, 16, 10).cast("int"))


def broadcast_address(ip: Column, mask: Column) -> Column:
    """Dotted address with all bits set that the mask leaves free."""
    return F.array_join(F.zip_with(F.split(ip, "[.]"), F.split(mask, "[.]"), lambda a, m: a.cast("int").bitwiseOR(255 - m.cast("int")).cast("string")), ".")
