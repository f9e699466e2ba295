"""Predicates that tell names from what text recognition makes of icons, ratings and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import TOKEN, TOKEN_AMP, TOKEN_PLAIN, count_of, find_all, fold, has_digit, has_listed_mark, has_mark, is_upper, starts_lower, starts_upper, strip, tokens

Known = Callable[[Column], Column]

# Parts and whole words that recognition makes of icon borders.
JUNK_HEADS = "con col com comm cor cot cos can trn trans contra contr inter hype como trns colinter ant antr dis disc discol".split()
JUNK_TAILS = (
    "s es ers ins inters ess he ste cars c ar shone gers tracess ces cess monums phousness anshone cars ication che tess ness mogers "
    "anaTis naTis interpLat interpOUm prOUm OUm com intersm intersM vers sstering teris tracOM cOM COM"
).split()
JUNK_WORDS = (
    "quantousus quantous unstitute discepter collo coliner communs co1 derrigermin1 rorizo pronaganda mazzer disserian chotol "
    "priviness toescaly pravered dismitted disminery"
).split()
MORE_HEADS = "disterat terat".split()
MORE_TAILS = ["eritonerizede"]
NOT_JUNK = "business fitness wellness".split()
TOKEN_TAILS = "erian iness teris cess tess tracess oum natis shone mogers phousness interpoum".split()
TOKEN_JUNK = (
    "disserian quantousus unstitute discepter pravered priviness toescaly chotol dismitted rorizo pronaganda mazzer bete luwcate"
).split()
CATEGORY_HEADS = (
    "store shop accessories accessory fashion souvenir restaurant cafe coffee bar lounge spa clinic office department market mall "
    "school bank hotel attraction tourist vietnamese food meal takeaway pharmacy drugstore hospital station terminal airport museum "
    "gallery library parking lot"
).split()
BAD_PARTS = "obst obs overstress couth quts orns orng ongame oriem ducas seruper postotice pertume obtrined parigheness qutminh qut".split()
ARTIFACT_HEADS = "com con col cor cos cot dis dist dir der pr trn trans inter contra hype".split()
ARTIFACT_TAILS = "esst ess sst sted chest ness cess tess tracess oum natis shone ication ification inten inter inters".split()
ADMIN_KEYS = "tp cn k q p".split()

# Words taken as known without any dictionary.
COMMON_WORDS = (
    "va co la den di cho quan bo pho bun com circle arabica coffee tea spa gym hotel restaurant cafe bar pub lounge shop store mart "
    "clinic studio bank atm residence station office post school park garden center plaza tower building mall market highlands "
    "starbucks passio phuc long cheese kfc lotteria jollibee mcdonald domino pizza hut subway tous les jours paris baguette givral "
    "brodard abc winmart coopmart lotte aeon satra emart seven eleven gs25 ministop vietcombank vietinbank bidv agribank sacombank "
    "techcombank acb mbbank vpbank shb vib tpb ocb scb hdbank eximbank nxb"
).split()
CONTEXT_WORDS = "xe tho vat mia cung lam".split()


def known_by(words: list[str]) -> Known:
    """A predicate for tokens whose folded form is listed; larger dictionaries belong in a join (see operators.dictionary)."""
    listed = sorted(set(words))
    return lambda c: (F.coalesce(c, F.lit("")) != "") & fold(c).isin(listed)


built_in = known_by([*COMMON_WORDS, *CONTEXT_WORDS])


def _any(parts: list[str]) -> str:
    return "(?:" + "|".join(parts) + ")"


def _plain(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)


def junk_line(c: Column) -> Column:
    """A line that is a rating, a number, or noise rather than a name."""
    s = strip(F.coalesce(c, F.lit("")))
    plain = _plain(s)
    low, total = F.lower(plain), F.length(plain)
    digits = count_of(plain, "[0-9]")
    rating = s.rlike(r"^\p{Nd}+(\.\p{Nd}+)?\s*\(\p{Nd}+\)$|^\(\p{Nd}+\)$|^\p{Nd}+(\.\p{Nd}+)?$|^\p{Nd}+(\.\p{Nd}+)?%\s*\(\p{Nd}+\)|^\p{Nd}+(\.\p{Nd}+)?\s*\(\p{Nd}+\)\s*-\s*")
    numbers = s.rlike(r"\p{Nd}{5,}|^0{3,}")
    mostly_digits = (digits >= 4) & (_share(digits, total) > 0.65) & (_share(total - digits, total) < 0.20)
    border = plain.rlike(f"(?i)^{_any(JUNK_HEADS)}{_any(JUNK_TAILS)}?$") | low.rlike("^dis[a-z]{3,}(?:ness|tess|cess|erian|minery)$")
    suffix = low.rlike("^[a-z]{5,}(?:ness|tess|cess)$") & ~low.isin(NOT_JUNK)
    mixed = low.rlike("[a-z][0-9]{2,}[a-z]") & (total >= 5)
    return rating | numbers | (plain == "") | mostly_digits | border | suffix | low.isin(JUNK_WORDS) | mixed


def junk_word(c: Column) -> Column:
    """A word that clean_junk_words() drops."""
    plain = _plain(c)
    heads, tails = _any([*JUNK_HEADS, *MORE_HEADS]), _any([*JUNK_TAILS, *MORE_TAILS])
    low = F.lower(plain)
    return plain.rlike("[0-9]{4,}|^0{3,}") | plain.rlike(f"(?i)^{heads}{tails}+$") | low.isin(JUNK_WORDS) | (low.rlike("[a-z][0-9]{2,}[a-z]") & (F.length(plain) >= 5))


def clean_junk_words(c: Column) -> Column:
    """The words that are not noise, without dangling punctuation at the ends."""
    words = F.filter(find_all(c, r"\S+"), lambda w: ~junk_word(w))
    return strip(F.regexp_replace(F.array_join(words, " "), r"^[\s,\-/]+|[\s,\-/]+$", ""))


def vowel_share(key: Column) -> Column:
    return _share(count_of(key, "[aeiouy]"), count_of(key, r"\p{L}"))


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c), with c computed once however often body reads it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _only_letters(c: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), "[^A-Za-zÀ-ỹĐđ0-9]", "")


def junk_token(c: Column, is_edge: Column, known: Known = built_in) -> Column:
    """A token without meaning. Known words, numbers, marked words and short acronyms never are."""
    token = _only_letters(c)
    return _junk(token, fold(token), is_edge, known)


def _junk(token: Column, key: Column, is_edge: Column, known: Known) -> Column:
    n = F.length(token)
    sound = known(token) | key.isin(ADMIN_KEYS) | has_digit(token) | has_mark(token) | (is_upper(token) & n.between(2, 6))
    noise = (
        (is_edge & (n <= 1) & ~starts_upper(token))
        | ((F.length(key) >= 7) & key.rlike(_any(TOKEN_TAILS) + "$"))
        | key.isin(TOKEN_JUNK)
        | ((F.length(key) >= 8) & ~starts_upper(token) & (count_of(key, r"\p{L}") > 0) & (vowel_share(key) < 0.25))
    )
    return (token == "") | (noise & ~sound)


def junk_token_count(c: Column, known: Known = built_in) -> Column:
    """Tokens without meaning over the segments of a label."""
    segments = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*/\s*"), strip), lambda s: s != "")

    def junk(w: Column, edge: Column) -> Column:
        return _let(_only_letters(w), lambda token: _let(fold(token), lambda key: _junk(token, key, edge, known)))

    def of(segment: Column) -> Column:
        return _let(find_all(segment, TOKEN_AMP), lambda words: F.size(F.filter(words, lambda w, i: junk(w, (i == 0) | (i == F.size(words) - 1)))))

    return F.aggregate(F.transform(segments, of), F.lit(0), lambda a, b: a + b)


def _upper_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: starts_upper(w) | is_upper(w)))


def category_segment(c: Column) -> Column:
    """A plain English category or description, not a name."""
    words = find_all(c, TOKEN_AMP)
    plain = ~F.exists(words, lambda w: has_digit(w) | has_mark(w))
    heads = F.array(*map(F.lit, CATEGORY_HEADS))
    return (F.size(words) <= 5) & plain & F.arrays_overlap(F.transform(words, fold), heads) & (_upper_words(words) <= 1)


VOWELS = "aeiouyàáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"


def bad_ocr(c: Column, known: Known = built_in) -> Column:
    """Text that recognition probably made up."""
    s = strip(F.coalesce(c, F.lit("")))
    low, words = fold(s), find_all(s, TOKEN_PLAIN)
    token = F.coalesce(F.get(words, 0), F.lit(""))
    key = fold(token)
    odd = token.rlike("[a-z][A-Z]") | (key.rlike("^" + _any(ARTIFACT_HEADS)) & key.rlike(_any(ARTIFACT_TAILS) + "$"))
    one = (F.size(words) == 1) & ~known(token) & ~has_mark(token) & ~has_digit(token) & (F.length(key) >= 6) & odd
    letters = count_of(low, r"\p{L}")
    few_vowels = F.size(words).between(1, 2) & ~has_digit(s) & (letters > 0) & (count_of(low, f"[{VOWELS}]") / F.nullif(letters, F.lit(0)) < 0.28)
    short = F.length(F.regexp_replace(s, "[^A-Za-zÀ-ỹ0-9]", "")) <= 4
    return short | low.rlike("|".join(BAD_PARTS)) | one | F.coalesce(few_vowels, F.lit(False))


def drop_name(c: Column, known: Known = built_in) -> Column:
    """A name that is an artefact: empty, one mixed token, or one token that looks made up."""
    words = find_all(strip(F.coalesce(c, F.lit(""))), TOKEN_AMP)
    token = F.coalesce(F.get(words, 0), F.lit(""))
    mixed = token.rlike(r"\p{L}") & has_digit(token) & ~has_mark(token) & ~is_upper(token)
    return (F.size(words) == 0) | ((F.size(words) == 1) & (mixed | (bad_ocr(token, known) & ~known(token))))


def strong_segment(c: Column) -> Column:
    """Several words, a marked word, a number, or a short acronym."""
    words = find_all(c, TOKEN_PLAIN)
    token = F.coalesce(F.get(words, 0), F.lit(""))
    return (F.size(words) >= 2) | ((F.size(words) == 1) & (token.rlike("[À-ỹ]") | has_digit(token) | (is_upper(token) & F.length(token).between(2, 6))))


def weak_edge_segment(c: Column) -> Column:
    """One word at the rim of a label that belongs to a neighbour or an icon."""
    s = strip(F.coalesce(c, F.lit("")))
    words = find_all(s, TOKEN_PLAIN)
    token = F.coalesce(F.get(words, 0), F.lit(""))
    key, n = fold(token), F.length(fold(token))
    lower_tail = token.rlike(r"^\p{Lu}") & (F.lower(F.substring(token, 2, 1_000)) == F.substring(token, 2, 1_000))
    shape = (starts_lower(token) & (n >= 5)) | (lower_tail & (n >= 8) & key.endswith("iness")) | (is_upper(token) & (n > 6))
    return ~s.rlike(r"^&\s*\.{2,}$") & (F.size(words) == 1) & ((n <= 3) | (~token.rlike(r"[À-ỹ]|\p{Nd}") & shape))


def clean_edge_segments(c: Column) -> Column:
    """A label without weak segments at its ends, as long as a strong one is left."""
    text = F.coalesce(c, F.lit(""))
    parts = F.filter(F.transform(F.split(text, r"\s*/\s*"), strip), lambda s: s != "")

    def judge(segment: Column) -> Column:
        """Most segments have several words, so their number decides."""
        judged = lambda weak, strong: F.struct(segment.alias("s"), weak.alias("weak"), strong.alias("strong"))
        n = F.size(find_all(segment, TOKEN_PLAIN))
        return _let(n, lambda n: F.when(n == 1, judged(weak_edge_segment(segment), strong_segment(segment))).otherwise(judged(F.lit(False), n >= 2)))

    def trim(kept: Column) -> Column:
        """Drop the first segments up to the first that must stay."""
        index = F.sequence(F.lit(0), F.size(kept) - 1)
        stays = lambda i: (i >= F.size(kept) - 1) | ~F.get(kept, i)["weak"] | ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda x: x["strong"])
        first = F.element_at(F.filter(index, stays), 1)
        return F.slice(kept, first + 1, F.size(kept))

    def joined(parts: Column) -> Column:
        trimmed = _let(_let(F.transform(parts, judge), lambda x: F.reverse(trim(x))), lambda x: F.reverse(trim(x)))
        return F.array_join(F.transform(trimmed, lambda x: x["s"]), " / ")

    return _let(parts, lambda p: F.when(F.size(p) < 2, strip(text)).otherwise(joined(p)))


def short_brand(c: Column, known: Known = built_in) -> Column:
    """One clean acronym of two to six letters."""
    from .scores import artifact_score

    words = find_all(c, TOKEN_AMP)
    token = F.coalesce(F.get(words, 0), F.lit(""))
    return (F.size(words) == 1) & F.length(token).between(2, 6) & is_upper(token) & (junk_token_count(token, known) == 0) & (artifact_score(token) == 0)


def brand_tokens(words: Column) -> Column:
    """A token array that dictionaries must not rewrite: empty, with numbers, or with an acronym other than TP."""
    upper = F.exists(words, lambda w: is_upper(w) & (F.length(w) > 1))
    return (F.size(words) == 0) | F.exists(words, has_digit) | (upper & F.exists(words, lambda w: w != "TP"))


def brand_token(c: Column) -> Column:
    """A token that dictionaries must not rewrite: with numbers, an acronym other than TP, a long capitalised Latin word."""
    token = F.coalesce(c, F.lit(""))
    latin = ~has_listed_mark(token) & token.rlike("^[A-Z][A-Za-z]{6,}$")
    return (token == "") | has_digit(token) | (is_upper(token) & (F.length(token) >= 2) & (token != "TP")) | latin


def brand_sensitive(c: Column) -> Column:
    """A name with an acronym or two long capitalised Latin words."""
    words = tokens(c, TOKEN)
    caps = F.exists(words, lambda w: is_upper(w) & (F.length(w) >= 2))
    latin = F.size(F.filter(words, lambda w: starts_upper(w) & ~has_mark(w) & (F.length(w) >= 5)))
    return caps | (latin >= 2)


def correctable(c: Column) -> Column:
    """A token that edit-distance correction may touch."""
    token = F.coalesce(c, F.lit(""))
    return ~brand_token(token) & token.rlike("^[A-Za-zÀ-ỹĐđ]{3,}$") & ~is_upper(token) & (has_listed_mark(token) | starts_lower(token))


def suspicious_short(c: Column) -> Column:
    """One short unmarked word with few vowels or an odd ending."""
    words = tokens(c, TOKEN)
    token = F.coalesce(F.get(words, 0), F.lit(""))
    key = fold(token)
    odd = (count_of(key, "[aeiouy]") / F.greatest(F.lit(1), F.length(key)) < 0.45) | key.rlike("[qxz]$|rx$")
    return (F.size(words) == 1) & F.length(key).between(4, 7) & ~has_mark(token) & ~has_digit(token) & ~is_upper(token) & odd


