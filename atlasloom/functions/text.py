"""Text columns: folding, tokens, keys, and the small rewrites of label text.

Patterns use only what Java's and RE2's expressions share, so that SQL can say the same.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Vietnamese letters that fold, by the letter they fold to.
FOLDS = (
    ("àáảãạăằắẳẵặâầấẩẫậ", "a"),
    ("èéẻẽẹêềếểễệ", "e"),
    ("ìíỉĩị", "i"),
    ("òóỏõọôồốổỗộơờớởỡợ", "o"),
    ("ùúủũụưừứửữự", "u"),
    ("ỳýỷỹỵ", "y"),
    ("đ", "d"),
)
MARKED = "".join(letters for letters, _ in FOLDS)
PLAIN = "".join(plain * len(letters) for letters, plain in FOLDS)

# The character classes of label text.
TOKEN = r"[A-Za-zÀ-ỹĐđ0-9]+"
TOKEN_AMP = r"[A-Za-zÀ-ỹĐđ0-9&]+"
TOKEN_DOT = r"[A-Za-zÀ-ỹĐđ0-9&.]+"
TOKEN_PLAIN = r"[A-Za-zÀ-ỹ0-9]+"
MARK = r"[À-ỹĐđ]"
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Administrative prefixes, tried in this order.
ADMIN_PREFIXES = ("Thành phố ", "Thanh pho ", "Tỉnh ", "Tinh ", "Quận ", "Quan ", "Huyện ", "Huyen ", "Thị xã ", "Thi xa ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def fold(c: Column) -> Column:
    """Lower case, Vietnamese letters without their marks; other letters stay. Null folds to empty."""
    return F.coalesce(F.translate(F.lower(c), MARKED, PLAIN), F.lit(""))


def find_all(c: Column, pattern: str) -> Column:
    """All matches; none in null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def tokens(c: Column, pattern: str = TOKEN) -> Column:
    return find_all(c, pattern)


def folded_tokens(c: Column, pattern: str = TOKEN) -> Column:
    return F.transform(find_all(c, pattern), fold)


def ascii_tokens(c: Column) -> Column:
    return find_all(fold(c), "[a-z0-9]+")


def count_of(c: Column, pattern: str) -> Column:
    return F.size(find_all(c, pattern))


def is_upper(c: Column) -> Column:
    """Some letter, and none that is not upper case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def starts_upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def starts_lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def has_digit(c: Column) -> Column:
    return c.rlike(r"\p{Nd}")


def has_mark(c: Column) -> Column:
    """A Vietnamese mark, by range: foreign letters from À to ỹ count too."""
    return F.coalesce(c.rlike(MARK), F.lit(False))


def has_listed_mark(c: Column) -> Column:
    """A Vietnamese mark, by letter."""
    return F.coalesce(F.lower(c).rlike(f"[{MARKED}]"), F.lit(False))


def has_shaped_vowel(c: Column) -> Column:
    """A letter that has a shape of its own without its tone."""
    return F.coalesce(F.lower(c).rlike("[ăằắẳẵặâầấẩẫậêềếểễệôồốổỗộơờớởỡợưừứửữự]"), F.lit(False))


def name_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]+", "")


def clean_name(c: Column) -> Column:
    """What two names are compared by: folded letters and digits."""
    return F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")


def strip_admin_prefix(c: Column) -> Column:
    """The name without the first administrative prefix, spaces collapsed."""
    return F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), "^(?:" + "|".join(ADMIN_PREFIXES) + ")", "")


@lru_cache
def _slug_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """From the Unicode tables: letters that decompose to one plain character, and those to several."""
    source, target, several = [], [], []
    for code in range(0xC0, 0x1EFA):
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x)).lower()
        if base != ch.lower() and len(base) == 1 and base.isascii():
            source.append(ch)
            target.append(base)
        elif len(base) > 1 and any(x.isascii() and x.isalnum() for x in base):
            several.append((ch, base))
    return "".join(source) + "đĐ", "".join(target) + "dd", tuple(several)


def slugify(c: Column) -> Column:
    """Plain lower-case words joined by underscores; `unknown` if none is left."""
    source, target, several = _slug_tables()
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{Mn}", "")
    for letter, plain in several:
        text = F.replace(text, F.lit(letter), F.lit(plain))
    text = F.regexp_replace(F.lower(F.translate(text, source, target)), "[^a-z0-9]+", "_")
    text = F.regexp_replace(text, "^_+|_+$", "")
    return F.when(text == "", "unknown").otherwise(text)


def centre_key(province: Column, district: Column) -> Column:
    return F.concat_ws("/", slugify(province), slugify(district))


def match_case(source: Column, canonical: Column) -> Column:
    """canonical in the rough casing of source."""
    first_lower = F.concat(F.lower(F.substring(canonical, 1, 1)), F.substring(canonical, 2, 1_000_000))
    return F.when(is_upper(source), F.upper(canonical)).when(starts_lower(source), first_lower).otherwise(canonical)


def better_duplicate(left: Column, right: Column) -> Column:
    """Of two tokens that fold alike: the one with more marks, else the capitalised one, else the left."""
    more = count_of(right, MARK) - count_of(left, MARK)
    return F.when(left == right, left).when(more > 0, right).when(more < 0, left).when(starts_upper(right) & ~starts_upper(left), right).otherwise(left)


def latin_distance(a: Column, b: Column) -> Column:
    """Edit distance ignoring case; 3 where the lengths differ by more than two."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.when(F.abs(F.length(a) - F.length(b)) > 2, 3).otherwise(F.levenshtein(a, b))


def keep_latin(c: Column) -> Column:
    """Without scripts and symbols that no label of the region uses."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-zÀ-ỹĐđ0-9\s/&.,%+'()\-–—]", " "))


def strip_rating_prefix(c: Column) -> Column:
    """Without a leading count in parentheses and what stands before it."""
    return F.regexp_replace(c, r"^.*?\([0-9]+(?:[.,][0-9]+)?\s*[KkM]?[+-]?\)\s*(?:[-·•*]\s*)?", "")


def strip_tail_notes(c: Column) -> Column:
    """Without a trailing rating, and then without trailing opening hours."""
    c = strip(F.regexp_replace(c, r"\s+[0-9]+(?:[.,][0-9]+)?\s*\(\s*[0-9]+\s*\)\s*$", ""))
    return strip(F.regexp_replace(c, r"(?i)\s+(?:open|closed)\s+[0-9]{1,2}(?::|\s)[0-9]{2}\s*(?:am|pm)?\s*$", ""))


def coordinate_text(lat: Column, lng: Column) -> Column:
    """`lat, lng` to six places; empty if either is null."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.format_string("%.6f, %.6f", lat, lng)).otherwise("")


def float_text(c: Column, places: int = 6) -> Column:
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c)).otherwise("")


def admin_area(ward: Column, district: Column) -> Column:
    """The parts that are not blank, joined by a comma."""
    kept = F.filter(F.array(strip(F.coalesce(ward, F.lit(""))), strip(F.coalesce(district, F.lit("")))), lambda x: x != "")
    return F.array_join(kept, ", ")


def slashes(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))


def split_name(c: Column) -> tuple[Column, Column]:
    """The main name and what follows the first ` / `, spaces collapsed."""
    parts = F.split(F.coalesce(c, F.lit("")), " / ")
    return collapse(F.element_at(parts, 1)), collapse(F.array_join(F.slice(parts, 2, 1_000_000), " / "))


def safe_file_name(c: Column, default: str = "Unknown") -> Column:
    name = strip(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/*?:"<>|]', ""), F.lit(" "), F.lit("_")))
    return F.when(name == "", default).otherwise(name)


def contains_run(container: Column, needle: Column) -> Column:
    """Whether the token array needle occurs in container without gaps; an empty needle does not."""
    padded = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(padded(container), padded(needle))


def unrelated(left: Column, right: Column) -> Column:
    """Both have tokens and share none."""
    a, b = ascii_tokens(left), ascii_tokens(right)
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
