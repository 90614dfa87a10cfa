"""Normalisation of multilingual names and addresses as column expressions.

Levels are cumulative: 0 lower case and white space; 1 compatibility forms, clean-up, folding of accents, splitting,
joining; 2 native words in Latin letters; 3 native words by learned dictionaries first (see
``operators.vocab.learn_dictionary``); 4 canonical forms. Everything runs in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical forms of name tokens.
NAME_FORMS = {
    "private": "pvt", "pvt": "pvt", "limited": "ltd", "ltd": "ltd", "incorporated": "inc", "corporation": "corp",
    "company": "co", "centre": "center", "services": "service", "brothers": "bros", "enterprises": "enterprise",
    "industries": "industry", "technologies": "technology", "societe": "ste", "compagnie": "cie",
    "etablissements": "ets", "associates": "assoc", "and": "and", "groupe": "group", "et": "and",
}
LEGAL_SKELETONS = {"prvt": "pvt", "lmtd": "ltd", "lmtt": "ltd", "lmt": "ltd"}
# Tokens that say little in a name.
GENERIC = (
    "pvt ltd llc llp lp inc corp co pc pllc plc the and of group service center partners holdings com smt dr mr mrs ms shri sarl sas "
    "sa eurl sasu sci snc ste cie et assoc public ets www de la le les du des france india usa ei eirl scp selarl selas scm gie scop sca sem sarlu"
).split()
# Canonical forms of address tokens, and tokens that are dropped.
ADDRESS_FORMS = {
    "street": "st", "str": "st", "saint": "st", "road": "rd", "drive": "dr", "avenue": "ave", "av": "ave",
    "avenu": "ave", "lane": "ln", "boulevard": "blvd", "bd": "blvd", "court": "ct", "place": "pl",
    "highway": "hwy", "parkway": "pkwy", "circle": "cir", "apartment": "apt", "suite": "ste", "floor": "fl",
    "flr": "fl", "flat": "flt", "north": "n", "south": "s", "east": "e", "west": "w", "first": "1st",
    "ist": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "chemin": "ch", "route": "rte",
    "impasse": "imp", "faubourg": "fbg", "sainte": "ste", "r": "rue",
    "bengaluru": "bangalore", "mysuru": "mysore", "gurugram": "gurgaon", "calcutta": "kolkata",
    "madras": "chennai", "bombay": "mumbai",
}
ADDRESS_DROPPED = "no nos plot door house hno shop null cedex number".split()
FRENCH_FORMS = {
    "allee": "all", "cours": "crs", "quai": "q", "residence": "res", "appt": "apt", "appartement": "apt",
    "chem": "ch", "square": "sq", "passage": "pass", "fg": "fbg", "lotissement": "lot", "hameau": "ham",
    "lieudit": "ld", "promenade": "prom", "esplanade": "esp", "carrefour": "carr", "traverse": "trav",
}
FRENCH_DROPPED = "bis ter n a b c d l de la le les du des et en".split()
# Codes of states and regions by country.
STATES = {
    "US": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
        "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
        "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
        "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
        "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
        "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
        "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
        "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
        "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
        "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    },
    "India": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg",
        "chattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp",
        "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh",
        "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od",
        "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn", "telangana": "tg",
        "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb",
        "delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la", "chandigarh": "ch", "puducherry": "py",
        "pondicherry": "py", "andaman and nicobar islands": "an", "lakshadweep": "ld",
        "dadra and nagar haveli": "dn", "daman and diu": "dd", "ts": "tg", "or": "od", "ct": "cg", "ut": "uk",
    },
    "France": {
        "hauts de france": "hdf", "nord": "hdf", "pas de calais": "hdf", "somme": "hdf", "aisne": "hdf", "oise": "hdf",
        "nouvelle aquitaine": "naq", "gironde": "naq", "landes": "naq", "pyrenees atlantiques": "naq",
        "dordogne": "naq", "lot et garonne": "naq", "charente": "naq", "charente maritime": "naq", "vienne": "naq",
        "deux sevres": "naq", "haute vienne": "naq", "creuse": "naq", "correze": "naq",
        "pays de la loire": "pdl", "loire atlantique": "pdl", "maine et loire": "pdl", "mayenne": "pdl",
        "sarthe": "pdl", "vendee": "pdl", "ile de france": "idf", "paris": "idf", "auvergne rhone alpes": "ara",
        "rhone": "ara", "provence alpes cote d azur": "paca", "provence alpes cote dazur": "paca",
        "bouches du rhone": "paca", "occitanie": "occ", "haute garonne": "occ", "grand est": "ges", "bretagne": "bre",
        "normandie": "nor", "bourgogne franche comte": "bfc", "centre val de loire": "cvl", "corse": "cor",
    },
}
# Sounds that are written alike, in the order they are merged.
SOUNDS = (("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("jh", "j"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("w", "v"), ("z", "j"), ("c", "k"))

# The range of native scripts, and marks of no width.
INDIC = r"ऀ-ൿ"
ZERO_WIDTH = r"[​-‏﻿]"


def _folding() -> tuple[str, str]:
    """Characters that become one ASCII character by compatibility decomposition without marks, and these."""
    old, new = [], []
    for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if len(plain) == 1 and plain.isascii() and plain != chr(c):
            old.append(chr(c))
            new.append(plain)
    return "".join(old), "".join(new)


FOLD_FROM, FOLD_TO = _folding()


def _compatibility() -> tuple[dict[str, str], tuple[str, str]]:
    """Characters outside of native scripts that compatibility composition writes with several characters, and the ones it writes with another one."""
    several, single = {}, []
    for c in [*range(0xA0, 0x900), *range(0x1D00, 0x2500), *range(0x3200, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:
        plain = unicodedata.normalize("NFKC", chr(c))
        if plain != chr(c):
            if len(plain) > 1:
                several[chr(c)] = plain
            else:
                single.append((chr(c), plain))
    return several, ("".join(a for a, _ in single), "".join(b for _, b in single))


SEVERAL, SINGLE = _compatibility()


def _native() -> dict[str, str]:
    """Native characters in Latin letters, by their Unicode names. A consonant ends in \x01, where an inherent a stands unless \x02 (a vowel sign, or a virama) follows."""
    out = {}
    for c in range(0x900, 0xD80):
        name = unicodedata.name(chr(c), "")
        kind, _, sound = name.partition(" LETTER ")
        sign = name.partition(" VOWEL SIGN ")[2]
        plain = lambda x: x.lower().replace("vocalic ", "").replace("short ", "").replace("candra ", "").replace("aa", "a").replace("ii", "i").replace("uu", "u").split(" ")[-1]
        if "VIRAMA" in name:
            out[chr(c)] = "\x02"
        elif sign:
            out[chr(c)] = "\x02" + plain(sign)
        elif sound and len(sound) > 1 and sound.endswith("A") and sound not in ("AA", "VOCALIC AA"):
            out[chr(c)] = plain(sound)[:-1] + "\x01"
        elif sound:
            out[chr(c)] = plain(sound)
        elif " DIGIT " in name:
            out[chr(c)] = str(unicodedata.digit(chr(c), ""))
        elif name.endswith((" SIGN ANUSVARA", " SIGN CANDRABINDU")):
            out[chr(c)] = "n"
        elif name:
            out[chr(c)] = ""
    return out


NATIVE = _native()


def chain(column: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, replacement in steps:
        column = F.regexp_replace(column, pattern, replacement)
    return column


def constant_map(table: dict[str, str]) -> Column:
    """A map of strings as one constant of the plan, however long."""
    listed = lambda x: F.split(F.lit("\x03".join(x)), "\x03", -1)
    return F.map_from_arrays(listed(table.keys()), listed(table.values()))


def spelled(column: Column, table: dict[str, str]) -> Column:
    """Each character as the table has it; others as they are."""
    known = constant_map(table)
    return F.array_join(F.transform(F.split(column, ""), lambda c: F.coalesce(F.element_at(known, c), c)), "")


def compose(column: Column) -> Column:
    """Compatibility composition of what stands outside of native scripts: ligatures, fractions, letterlike and full-width forms."""
    one = F.translate(column, *SINGLE)
    return F.when(column.rlike("[" + "".join(SEVERAL) + "]"), spelled(one, SEVERAL)).otherwise(one)


def transliterate(column: Column) -> Column:
    """Native words in Latin letters, by the names of their characters."""
    s = chain(spelled(column, NATIVE), ("\x01\x02", ""), ("\x01", "a"), ("\x02", ""))
    return F.when(has_native(column), s).otherwise(column)


def native_runs(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(f"([{INDIC}]+)"))


def plain_words(column: Column) -> Column:
    """Words for profiles: accents folded, marks dropped, all else but letters, digits and underscores a gap."""
    return squeeze(F.regexp_replace(fold(F.lower(compose(column))), r"[^\p{L}\p{N}_]+", " "))


def has_native(column: Column) -> Column:
    return column.rlike(f"[{INDIC}]")


def is_non_ascii(column: Column) -> Column:
    return column.rlike(r"[^\x00-\x7F]")


def fold(column: Column) -> Column:
    """Accents and full-width forms to plain ASCII; combining marks of Latin go, native scripts stay."""
    return F.regexp_replace(F.translate(column, FOLD_FROM, FOLD_TO), r"[̀-ͯ]", "")


def squeeze(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"\s+", " "))


def tokens(column: Column) -> Column:
    """Runs of digits, ASCII letters and native letters, without leading zeros of numbers."""
    parts = F.filter(F.split(column, f"[^0-9a-z{INDIC}]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.when(t.rlike(r"^\d+$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).otherwise(t))


def without_repeats(words: Column) -> Column:
    """Drops each token that equals the one before it."""
    return F.filter(words, lambda t, i: (i == 0) | (t != F.get(words, F.greatest(i - 1, F.lit(0)))))


def clean(column: Column, field: str = "name") -> Column:
    """Level 1 up to the tokens, as text."""
    s = F.lower(compose(F.regexp_replace(column, ZERO_WIDTH, "")))
    s = F.translate(s, "’'", "")
    s = chain(
        s, ("&", " and "), (r"\bn\s*[°º]", " no "),
        (r"\b(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|in|net|org|co|io|biz|info|fr|us)\b", " $1 "),
    )
    if field == "name":
        s = chain(s, (r"\b\d{8,}\b", " "), (r"#\s*\d+", " "))
    s = chain(s, (r"<\s*null\s*>|\bnull\b", " "))
    return chain(fold(s), (r"(?<=\d)(?=(?!(?:st|nd|rd|th)\b)[a-z])|(?<=[a-z])(?=\d)", " "))


def form(token: Column, forms: dict[str, str]) -> Column:
    """The canonical form of a token, else null."""
    return F.element_at(constant_map(forms), token)


def skeleton(token: Column) -> Column:
    """Consonants of a token after merging sounds; the first letter stays, repeats fall together, numbers stay."""
    s = token
    for old, new in SOUNDS:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.concat(F.left(s, F.lit(1)), F.regexp_replace(F.substring(s, 2, 1 << 20), "[aeiouy]", ""))
    return F.when(token.rlike(r"^\d*$"), token).otherwise(F.regexp_replace(s, r"(.)\1+", "$1"))


def canonical_name(words: Column) -> Column:
    def one(t: Column) -> Column:
        legal = F.when((F.length(t) >= 5) & t.rlike(f"^[a-z{INDIC}]+$"), form(skeleton(t), LEGAL_SKELETONS))
        return F.coalesce(form(t, NAME_FORMS), legal, t)

    return F.transform(words, one)


def canonical_address(words: Column, country: Column) -> Column:
    """Region names to codes (several words first, the longest before others), marker words out, street types short."""
    s = F.array_join(words, " ")
    every = s
    for name, states in STATES.items():
        phrases = sorted((k for k in states if " " in k), key=len, reverse=True)
        of = s
        for p in phrases:
            of = F.regexp_replace(of, rf"\b{p}\b", states[p])
        every = F.when(country == name, of).otherwise(every)
    french = F.coalesce(country == "France", F.lit(False))

    def one(t: Column) -> Column:
        state = F.lit(None).cast("string")
        for name, states in STATES.items():
            state = F.when(country == name, form(t, states)).otherwise(state)
        short = F.coalesce(state, form(t, ADDRESS_FORMS), t)
        return F.when(french, F.coalesce(form(short, FRENCH_FORMS), short)).otherwise(short)

    kept = F.filter(F.split(every, " "), lambda t: (t != "") & ~t.isin(ADDRESS_DROPPED) & ~(french & t.isin(FRENCH_DROPPED)))
    return F.transform(kept, one)


def normalize(column: Column, level: int = 4, field: str = "name", country: Column | None = None, dictionary: Column | None = None, other: Column | None = None) -> Column:
    """dictionary: a map column from native to Latin words, for levels 3 and up; other: that of the other field, asked second. Native words in neither are spelled in Latin letters."""
    column = F.coalesce(column, F.lit(""))
    if level <= 0:
        return squeeze(F.lower(F.regexp_replace(column, ZERO_WIDTH, "")))
    words = tokens(clean(column, field))
    if level >= 2:
        known = [d for d in (dictionary, other) if d is not None and level >= 3]
        latin = lambda t: F.coalesce(*(F.element_at(d, t) for d in known), transliterate(t))
        words = F.filter(F.split(F.array_join(F.transform(words, latin), " "), " "), lambda t: t != "")
    # Single letters in a row are one token.
    words = F.split(F.regexp_replace(F.array_join(words, " "), "(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", ""), " ")
    words = F.flatten(F.transform(F.array(words), without_repeats))
    if level >= 4:
        words = canonical_name(words) if field == "name" else canonical_address(words, F.lit(None).cast("string") if country is None else country)
    return F.array_join(words, " ")


def core_name(words: Column) -> Column:
    """Tokens that are not generic; all of them if none is left."""
    kept = F.filter(words, lambda t: ~t.isin(GENERIC))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def numbers(address: Column) -> Column:
    """Distinct numbers of an address, without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(address, F.lit(r"(\d+)")), lambda t: F.regexp_replace(t, "^0+(?=[0-9])", "")))


def first_number(address: Column) -> Column:
    return F.coalesce(F.get(numbers(address), F.lit(0)), F.lit(""))


def postcodes(address: Column) -> Column:
    """Distinct runs of 5 or 6 digits; 3 and 3 digits with a space between are one."""
    joined = F.regexp_replace(address, r"(?<!\d)(\d{3}) (\d{3})(?!\d)", "$1$2")
    return F.array_distinct(F.filter(F.regexp_extract_all(joined, F.lit(r"(\d+)")), lambda t: F.length(t).between(5, 6)))


def components(address: Column, level: int = 4, country: Column | None = None) -> Column:
    parts = F.transform(F.split(address, ","), lambda c: normalize(c, level, "addr", country))
    return F.array_distinct(F.filter(parts, lambda c: c != ""))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the text between two spaces; an empty text has none."""
    # One walk over the text: substring would count the characters from its start for each run.
    runs = F.regexp_extract_all(F.concat(F.lit(" "), text, F.lit(" ")), F.lit("(?s)(?=(.{3}))."))
    return F.when(F.length(text) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def trigram_codes(text: Column) -> Column:
    """The trigrams as numbers, of 21 bits for each character: a third of their size where many sets move."""
    code = lambda t, i: F.ascii(F.substring(t, i, 1)).cast("long") * (1 << 21 * (3 - i))
    return F.transform(trigrams(text), lambda t: code(t, 1) + code(t, 2) + code(t, 3))


def word_grams(text: Column, least: int = 3, most: int = 3) -> Column:
    """Character n-grams of each word between two spaces, with repeats; a word shorter than n gives itself, padded."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def of(n: int) -> Column:
        def grams(w: Column) -> Column:
            s = F.concat(F.lit(" "), w, F.lit(" "))
            return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))

        return F.flatten(F.transform(words, grams))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def joint_text(name: Column, address: Column, prefix: str = "query: ") -> Column:
    return F.concat(F.lit(prefix), name, F.when(address != "", F.concat(F.lit(" , "), address)).otherwise(""))
