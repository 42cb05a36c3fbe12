"""Surrogates for personal data and secrets, in DataFrame operations only.

Entities are found by patterns, card and account numbers by their check digits too; a name found after a title or a phrase is found again wherever its words stand in the same text. An entity's canonical form
(without separators or case where its type ignores them) is replaced by a keyed surrogate of the same type and shape: digits for digits, right check digits, letters of the same script for letters, a name of the
same gender and script for a name. Each occurrence takes the surrogate in its own format, so all mentions of an entity stay one
entity. Over the whole corpus no two entities of a type share a surrogate, and no surrogate is an entity of the corpus: colliding ones are drawn again, longer in time.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.common import hot_join, materialize, scratch, small

#: Private-use characters that mark what was found; where a text has them itself they are escaped.
OPEN, CLOSE, ESCAPE, MALE, FEMALE, EITHER, BARE = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005", "\ue006"

#: Patterns by type, tried in this order at each place of a text. The one that holds most texts back comes first in each: a class of first characters.
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}[\p{L}]{2,24}(?![\p{L}\p{N}-])",
    "SECRET": r"(?=[Agsx0-9a-f])(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,255}|sk-[A-Za-z0-9_-]{16,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|[0-9a-f]{32,128})(?![\p{L}\p{N}])",
    "IP": r"(?=[0-9])(?<![\p{L}\p{N}.])(?<!(?i:version|release|build|ver|v)[ .:]{1,2})(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)",
    "MAC": r"(?=[0-9A-Fa-f]{2}[:-])(?<![\p{L}\p{N}:-])(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}(?![\p{L}\p{N}:-])",
    "IP6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:(?:[0-9A-Fa-f]{1,4}:){2,6}|(?i:fe80|f[cd][0-9a-f]{2}):):(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4})(?![\p{L}\p{N}:])",
    "IBAN": r"(?=[A-Z]{2}\d)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "CARD": r"(?=[2-6])(?<![\p{L}\p{N}+.-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "SSN": r"(?=[0-9])(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "PHONE": r"(?=[0-9+(])(?:(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,5}(?:[ .-]?\d{2,5}){1,3}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.+-])(?:\d{3}[.-]\d{3}[.-]\d{4}|[2-9]\d\d [2-9]\d\d[ -]\d{4}|0\d(?:[ .]\d\d){4}|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?![\p{L}\p{N}-]))",
}
#: A number of seven to twelve digits after a word that says what it is.
CALLED = r"(?=[TtPpCcMmFfWwHh])(?<![\p{L}\p{N}])((?i:telephone|telefon|teléfono|phone|tel|call|mobile|móvil|cell|fax|whatsapp|handy)[.: ]{1,3})(\d{7,12})(?![\p{L}\p{N}.,-]\d|[\p{L}\p{N}])"
#: A secret after its name: the name and sign, the value.
KEYED = r"(?=[PpSsTtAa])((?i:password|passwd|pwd|secret|token|api_key|apikey|api-key)[ \t]{0,2}[=:][ \t]{0,2}[\"']?)([^\s\"'=:-]{6,255})"
#: A word of a name (O'Brien, McAllen, Li; an apostrophe and one letter, as in Li's, is not of it), names of them, and names in capitals.
WORD = r"(?:\p{Lu}['’]\p{L}{2,30}|\p{Lu}\p{Ll}{1,30}(?:\p{Lu}\p{Ll}{1,30})?(?:['’](?!(?:ll|ve|re)(?!\p{L}))\p{L}{2,30})?)"
CAPITALS = r"\p{Lu}{1,30}(?:['’-]\p{Lu}{2,30}|\p{Lu})(?!\p{L})"
NAME = rf"(?:{WORD}(?:[ -]{WORD}){{0,2}}|{CAPITALS}(?: {CAPITALS})?)"
MALE_TITLES = r"Mr|Sir|Lord|Herrn|Herr|Monsieur|Señor|Sr|Don|Господин|господин|Г-н|г-н|Κύριος|κύριος|Κύριο|κύριο|κ"
FEMALE_TITLES = r"Mrs|Miss|Ms|Madame|Madam|Lady|Frau|Mme|Mlle|Señorita|Señora|Srta|Sra|Doña|Госпожа|госпожа|Г-жа|г-жа|Κυρία|κυρία|κα"
#: Titles of either gender, which may also follow another title.
ANY_TITLES = r"Professor|Prof|Doctor|Dr|Dra|Judge|Rev|Captain|Capt|Доктор|доктор|Профессор|профессор|Δρ"
#: Words of two letters that begin sentences, which are no mentions of a name that is spelt like one.
SHORT_WORDS = "Al Am An As At Be By Da De Do Du El En Er Es Et Go He If Il Im In Is It La Le Lo Me My No Of On Or Se So To Tu Un Up Us We Zu"
#: Phrases that a name of either gender follows.
PHRASES = r"[Mm]y name is|[Nn]ame is|[Nn]ame:|[Hh]eiße|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут|[Μμ]ε λένε"
#: Scripts without capitals: titles before one word, and titles after a common Chinese family name and up to two more characters.
BEFORE = {MALE: "السيد|श्री", FEMALE: "السيدة|श्रीमती"}
AFTER = {MALE: "先生", FEMALE: "女士|小姐|太太"}
FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁任卢姚钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱江尹薛阎段雷侯龙史陶黎贺顾毛郝龚邵万钱严"
NAMES = {tag: rf"(?=[DFHLMSГгΚκ])(?<![\p{{L}}\p{{N}}])((?:{titles})\.? (?:(?:{ANY_TITLES})\.? )*)({NAME})" for tag, titles in ((MALE, MALE_TITLES), (FEMALE, FEMALE_TITLES))}
NAMES[EITHER] = rf"(?=[CDJMmNnHhjPRДдПпМмΔΜμ])(?<![\p{{L}}\p{{N}}])((?:(?:{ANY_TITLES})\.?(?: (?:{ANY_TITLES})\.?)*|{PHRASES}) )({NAME})"
UNCASED = {tag: rf"(?<![\p{{L}}\p{{M}}])((?:{BEFORE[tag]}) )([\p{{IsArabic}}\p{{IsDevanagari}}\p{{M}}]{{2,20}})" for tag in BEFORE}
CHINESE = {tag: rf"()([{FAMILY}]\p{{IsHan}}{{0,2}})(?={AFTER[tag]})" for tag in AFTER}


def has_entity(text: Column) -> Column:
    """Whether a text has an entity. Every pattern is tried only on texts with a string or character that it needs."""
    digit = text.rlike("[0-9]")
    known = text.contains("AKIA") | text.contains("sk-") | text.contains("xox") | text.contains("gho_") | text.contains("ghp_") | text.contains("ghu_") | text.contains("ghs_") | text.contains("ghr_") | (digit & text.rlike("[0-9a-f]{32}"))
    numbers = "(?=[0-9+(A-Z])(?:" + "|".join(PATTERNS[k] for k in ("IP", "IBAN", "CARD", "SSN", "PHONE")) + ")"
    paired = (text.contains(":") | text.contains("-")) & text.rlike("[0-9A-Fa-f]{1,4}[:-][0-9A-Fa-f]{0,4}[:-]") & text.rlike(PATTERNS["MAC"] + "|" + PATTERNS["IP6"])
    named = text.rlike(r"[CDFHJLMPRSГгДдПпΚκΔ][\p{L}-]{0,8}\.? \p{Lu}|(?:ame(?: is|:)|eiße|appelle|llamo|зовут|λένε) \p{Lu}")
    uncased = text.rlike("السيد|श्री|先生|女士|小姐|太太") & text.rlike("|".join([*UNCASED.values(), *CHINESE.values()]))
    found = (digit & text.rlike(numbers)) | (text.contains("@") & text.rlike(PATTERNS["EMAIL"])) | (known & text.rlike(PATTERNS["SECRET"]))
    found = found | ((text.contains("=") | text.contains(":")) & text.rlike(KEYED)) | (named & text.rlike("|".join(NAMES.values())))
    return F.coalesce(found | paired | uncased | (digit & text.rlike(CALLED)), F.lit(False))


#: Types whose separators don't tell entities apart.
JOINED = ("IBAN", "CARD", "SSN", "PHONE", "MAC")
#: Kept at the start of a secret, an account or a phone number: what tells its kind; at the end of an address: its top domain.
KEPT_START = {"PHONE": r"^\d(?=\d{10})", "SECRET": r"^(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)", "IBAN": r"^[A-Z]{2}", "CARD": r"^\d", "IP6": r"^[0-9a-f]{1,4}:"}
KEPT_END = {"EMAIL": r"\.\p{L}+$"}
#: Attempts after which a surrogate grows by a character for every so many more.
GROWS_FROM, GROWS_EVERY = 20, 10

#: Scripts of names, sixteen syllables of each, and endings by gender.
SCRIPTS = {"latin": r"\p{L}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}"}
SYLLABLES = {
    "latin": "ba de fi go lu ma ne pi ro su ta ve zo ka le mi", "cyrillic": "ба де фи го лу ма не пи ро су та ве зо ка ле ми", "greek": "βα δε φι γο λυ μα νε πι ρο συ τα βε ζο κα λε μι",
    "arabic": "با دي في غو لو ما ني بي رو سو تا وي زو كا لي مي", "devanagari": "बा दे फि गो लु मा ने पि रो सु ता वे जो का ले मि", "han": "安 博 成 德 恩 光 海 嘉 康 立 明 宁 平 庆 荣 文",
}
ENDINGS = {
    "latin": {"GIVEN_M": "n", "GIVEN_F": "na", "GIVEN_N": "l", "SURNAME": "ster"}, "cyrillic": {"GIVEN_M": "н", "GIVEN_F": "на", "GIVEN_N": "ль", "SURNAME": "рин"},
    "greek": {"GIVEN_M": "ς", "GIVEN_F": "να", "GIVEN_N": "λ", "SURNAME": "κος"}, "arabic": {"GIVEN_M": "ن", "GIVEN_F": "ة", "GIVEN_N": "ل", "SURNAME": "ري"},
    "devanagari": {"GIVEN_M": "न", "GIVEN_F": "ना", "GIVEN_N": "ल", "SURNAME": "कर"}, "han": {"GIVEN_M": "伟", "GIVEN_F": "芳", "GIVEN_N": "", "SURNAME": "家"},
}
#: Where a deployment keeps the key of its surrogates.
KEY_SETTING = "spark.wardlight.surrogate.key"


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING of the session; where it is unset, as in tests, a public one, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are drawn with a key that everybody knows", stacklevel=2)
    return key or "wardlight-2024"


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn_digit(body: Column) -> Column:
    """The digit that ends a card number."""
    doubled = lambda c: F.when(c > 4, c * 2 - 9).otherwise(c * 2)
    total = F.aggregate(F.transform(_characters(F.reverse(body)), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def mod_97(account: Column) -> Column:
    """An account number's remainder, its letters read as 10 to 35; 1 for a right one with its first four characters at its end."""
    digits = F.array_join(F.transform(_characters(account), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.aggregate(_characters(digits), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)


def is_valid(kind: Column, bare: Column) -> Column:
    """Whether a number's check digits are right; true for types without."""
    account = mod_97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1
    return F.when(kind == "CARD", F.call_function("luhn_check", bare)).when(kind == "IBAN", account).otherwise(F.lit(True))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 512)


def _nibble(digest: Column, i: Column) -> Column:
    """Two hex digits of the digest as a number, by any index."""
    return F.conv(F.substring(digest, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")


def _reshaped(canon: Column, digest: Column, first: Column, last: Column) -> Column:
    """canon with each letter and digit after `first` and up to `last` characters replaced by one of its kind."""

    hex_only = canon.rlike("^[0-9a-f:]+$")

    def one(c: Column, i: Column) -> Column:
        n = _nibble(digest, i)
        pick = lambda start, count: F.decode(F.encode(F.chr(F.lit(start) + n % count), "UTF-8"), "UTF-8")
        of = lambda letters: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
        new = (
            F.when(c.rlike("[0-9]"), pick(48, 10)).when(c.rlike("[a-z]"), F.when(hex_only, pick(97, 6)).otherwise(pick(97, 26))).when(c.rlike("[A-Z]"), pick(65, 26))
            .when(c.rlike(r"\p{IsCyrillic}"), of("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"\p{IsGreek}"), of("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"\p{L}"), of("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
        )
        return F.when((i >= first) & (i < last), new).otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def candidate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The keyed surrogate of a canonical entity at an attempt."""
    digest = _digest(key, kind, canon, attempt.cast("string"))
    first, last = F.lit(0), F.length(canon)
    for k, pattern in KEPT_START.items():
        first = F.when(kind == k, F.length(F.regexp_extract(canon, pattern, 0))).otherwise(first)
    for k, pattern in KEPT_END.items():
        last = F.when(kind == k, F.length(canon) - F.length(F.regexp_extract(canon, pattern, 0))).otherwise(last)
    octet = lambda i, low, n: (F.pmod(F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int"), F.lit(n)) + low).cast("string")
    address = F.concat_ws(".", octet(0, 11, 200), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        table = F.array(*[F.lit(s) for s in syllables.split()])
        parts = [F.element_at(table, F.conv(F.substring(digest, i + 1, 1), 16, 10).cast("int") + 1) for i in range(3)]
        more = F.concat_ws("", F.transform(F.sequence(F.lit(0), attempt), lambda a: F.when(a > 0, F.element_at(table, F.conv(F.substring(digest, F.pmod(a + 10, F.lit(126)) + 1, F.lit(1)), 16, 10).cast("int") + 1)).otherwise("")))
        ending = F.lit("")
        for k, e in ENDINGS[script].items():
            ending = F.when(kind == k, F.lit(e)).otherwise(ending)
        name = F.when(canon.rlike(SCRIPTS[script]), F.concat(*parts, more, ending)).otherwise(name)
    grown = F.greatest(F.lit(0), F.floor((attempt - GROWS_FROM) / GROWS_EVERY)).cast("int")
    tail = F.substring(F.sha2(F.concat(digest, F.lit("+")).cast("binary"), 512), F.lit(1), grown)
    digits, letters = F.translate(tail, "abcdef", "012345"), F.translate(tail, "0123456789", "ghijklmnop")
    shaped = _reshaped(canon, digest, first, last)
    body = F.concat(F.substring(shaped, F.lit(1), F.length(shaped) - 1), digits)
    account = F.concat(F.substring(shaped, F.lit(5), F.length(shaped)), digits)
    country = F.substring(canon, 1, 2)
    check = F.lpad((98 - mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return (
        F.when(kind == "IP", address).when(kind.isin(*ENDINGS["latin"]), name).when(kind == "CARD", F.concat(body, luhn_digit(body))).when(kind == "IBAN", F.concat(country, check, account))
        .when(kind == "EMAIL", F.concat(letters, shaped)).when(kind == "IP6", shaped).when(kind == "MAC", F.concat(shaped, tail)).otherwise(F.concat(shaped, digits))
    )


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate): one row for each distinct entity; surrogates are distinct in a kind and are no entity of it.

    A form that is too short to be other than all real ones grows (see GROWS_FROM), so the rounds end; of addresses there must be fewer than forms.
    """
    known = materialize(entities.select("kind", "canon").distinct())
    tried = materialize(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", candidate(F.col("kind"), F.col("canon"), F.lit(0), key)))
    while True:
        owners = tried.groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        real = known.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        judged = tried.join(owners, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        judged = judged.withColumn("bad", F.col("real").isNotNull() | (F.col("owner").isNotNull() & (F.col("owner") != F.col("canon"))))
        judged = materialize(judged.select("kind", "canon", "attempt", "surrogate", F.col("bad").alias("again")))
        if not judged.where("again").limit(1).count():
            return tried.select("kind", "canon", "surrogate")
        next_ = F.col("attempt") + 1
        tried = materialize(judged.select(
            "kind", "canon", F.when(F.col("again"), next_).otherwise(F.col("attempt")).alias("attempt"),
            F.when(F.col("again"), candidate(F.col("kind"), F.col("canon"), next_, key)).otherwise(F.col("surrogate")).alias("surrogate"),
        ))


def _in_format(found: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate as this occurrence writes it: its separators, its capitals."""
    kept = r"[^\p{L}\p{N}]"
    spread = F.array_join(
        F.transform(F.split(found, ""), lambda c, i: F.when(c.rlike(kept), c).otherwise(F.substring(surrogate, F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), kept, "")), F.lit(1)))), ""
    )
    letters = F.length(F.regexp_replace(found, kept, ""))
    spread = F.concat(spread, F.substring(surrogate, letters + 1, F.length(surrogate)))
    spread = F.when((kind == "MAC") & found.rlike("[A-F]"), F.upper(spread)).otherwise(spread)
    upper = F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(found, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    capital = F.when(found.rlike(r"^[\p{Lu}'’-]{2,}$"), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return F.when(kind.isin(*JOINED), spread).when(kind == "EMAIL", F.array_join(upper, "")).when(kind.isin(*ENDINGS["latin"]), capital).otherwise(surrogate)


def _kind(found: Column) -> Column:
    kind = F.lit("PHONE")
    for k in ("SSN", "CARD", "IBAN", "IP6", "MAC", "IP", "EMAIL"):
        kind = F.when(found.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(kind)
    shaped = found.rlike(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_.*|sk-.*|xox[abprs]-.*|[0-9a-f]{32,128})$")
    phone = found.rlike(f"^(?:{PATTERNS['PHONE']})$|^[0-9]{{7,12}}$")
    return F.when(shaped, "SECRET").when((kind == "PHONE") & ~phone, "SECRET").otherwise(kind)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with surrogates in its text column, all rows and columns; count_col, if given, is added: the entities found in the text (replaced if docs has it).

    A text without an entity, a null one and an empty one stay as they are. One key gives the same surrogates for the same entities of one corpus in every run. Repeated rows are replaced alike.
    Names count as entities after a title, a phrase of PHRASES or before a Chinese title, and then in the whole text. Numbers with wrong check digits are no cards or accounts. Columns of docs may have any names. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != count_col]
    text = F.col(text_col)
    has = has_entity(text)
    tags = {"a": OPEN, "b": CLOSE, "d": MALE, "e": FEMALE, "f": EITHER, "g": BARE}
    own = F.regexp_replace(text, ESCAPE, ESCAPE + "c")
    for code, c in tags.items():
        own = F.regexp_replace(own, c, ESCAPE + code)
    marked = F.regexp_replace(F.regexp_replace(own, KEYED, f"$1{OPEN}$2{CLOSE}"), CALLED, f"$1{OPEN}$2{CLOSE}")
    # what is marked already is taken as it is, and marked once
    as_is = f"{OPEN}[^{CLOSE}]*{CLOSE}"
    once = lambda c, mark: F.regexp_replace(F.regexp_replace(c, mark + OPEN, OPEN), CLOSE + CLOSE, CLOSE)
    marked = once(F.regexp_replace(marked, "|".join([as_is, *PATTERNS.values()]), f"{OPEN}$0{CLOSE}"), OPEN)
    for patterns in (NAMES, UNCASED, CHINESE):
        for tag, pattern in patterns.items():
            marked = F.regexp_replace(marked, pattern, f"$1{OPEN}{tag}$2{CLOSE}")
    of_person = f"[{MALE}{FEMALE}{EITHER}]"
    # a name's words, wherever else they stand in the text
    names = F.regexp_extract_all(F.col("_marked"), F.lit(f"{OPEN}{of_person}([^{CLOSE}]*){CLOSE}"), F.lit(1))
    words = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda n: F.split(n, " "))), lambda w: ((F.length(w) > 1) & ~w.isin(SHORT_WORDS.split()) & ~w.rlike(r"^\p{IsHan}$")) | w.rlike(r"^\p{IsHan}{2}")))
    # as the name writes them, in capitals, or without them if it is, with either apostrophe
    forms = lambda w: F.array(w, F.upper(w), F.when(w == F.upper(w), F.initcap(w)).otherwise(w))
    words = F.array_distinct(F.transform(F.flatten(F.transform(words, forms)), lambda w: F.regexp_replace(w, "['’]", "['’]")))
    split_ = lambda han: F.filter("_names", lambda w: w.rlike(r"\p{IsHan}") if han else ~w.rlike(r"\p{IsHan}"))
    again = F.concat(
        F.lit(as_is), F.when(F.size(split_(False)) > 0, F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?:"), F.array_join(split_(False), "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(""),
        F.when(F.size(split_(True)) > 0, F.concat(F.lit("|"), F.array_join(split_(True), "|"))).otherwise(""),
    )
    repeated = once(F.regexp_replace("_marked", again, F.lit(f"{OPEN}{BARE}$0{CLOSE}")), OPEN + BARE)
    entity = F.concat_ws(":", "kind", "canon").alias("_entity")
    with scratch():
        found = docs.where(has).select(F.struct(*columns).alias("_doc"), marked.alias("_marked"), F.monotonically_increasing_id().alias("_row"))
        found = found.withColumn("_names", words).withColumn("_marked", F.when(F.size("_names") > 0, repeated).otherwise(F.col("_marked")))
        found = materialize(found.select("_doc", "_row", F.split("_marked", f"[{OPEN}{CLOSE}]").alias("_pieces")), outer=True)

        # a name is its words: given names of a gender, and a surname
        pieces = found.select("_row", F.posexplode("_pieces").alias("_at", "_found")).where("_at % 2 = 1")
        tag = F.substring("_found", 1, 1)
        pieces = pieces.withColumn("_tag", F.when(tag.rlike(f"[{MALE}{FEMALE}{EITHER}{BARE}]"), tag)).withColumn("_found", F.when(F.col("_tag").isNotNull(), F.substring("_found", F.lit(2), F.length("_found"))).otherwise(F.col("_found")))
        pieces = pieces.withColumn("_words", F.when(F.col("_tag").isNotNull(), F.split("_found", " ")).otherwise(F.array("_found")))
        parts = pieces.select("_row", "_at", "_tag", F.size("_words").alias("_n"), F.posexplode("_words").alias("_k", "_found"))
        given = F.when(F.col("_tag") == MALE, "GIVEN_M").when(F.col("_tag") == FEMALE, "GIVEN_F").otherwise("GIVEN_N")
        role = F.when(F.col("_tag") == BARE, F.lit(None).cast("string")).when((F.col("_k") == F.col("_n") - 1) & ~F.col("_found").rlike(r"\p{IsHan}"), "SURNAME").otherwise(given)
        parts = parts.withColumn("kind", F.when(F.col("_tag").isNotNull(), role).otherwise(_kind(F.col("_found"))))
        bare = F.regexp_replace("_found", r"[^\p{L}\p{N}]", "")
        canon = F.when(F.col("kind") == "MAC", F.lower(bare)).when(F.col("kind").isin(*JOINED), F.upper(bare)).when(F.col("kind").isin("SECRET", "IP"), F.col("_found")).otherwise(F.lower(F.regexp_replace("_found", "’", "'")))
        parts = parts.withColumn("canon", canon).where(is_valid(F.col("kind"), F.col("canon")) | F.col("kind").isNull())
        parts = materialize(parts.select("_row", "_at", "_k", "_tag", "_found", "kind", "canon"))
        of_row = parts.where(F.col("_tag").isNotNull() & (F.col("_tag") != BARE)).groupBy("_row", "canon").agg(F.min("kind").alias("_named"))
        parts = materialize(parts.join(of_row, ["_row", "canon"], "left").withColumn("kind", F.coalesce("kind", "_named")).drop("_named", "_tag"))
        known = materialize(dictionary(parts, key).select(entity, "surrogate"))
        n_known = known.count()
        mentions = parts.select("*", entity)
        drawn = mentions.join(F.broadcast(known), "_entity") if small(known, n_known) is not known else hot_join(materialize(mentions), known, "_entity")  # a frequent entity is not one task
        drawn = drawn.withColumn("_new", _in_format(F.col("_found"), F.col("kind"), F.col("surrogate")))
        whole = drawn.groupBy("_row", "_at").agg(F.array_sort(F.collect_list(F.struct("_k", "_new"))).alias("_w"))
        whole = whole.select("_row", "_at", F.array_join(F.transform("_w", lambda w: w["_new"]), " ").alias("_new"))
        maps = materialize(whole.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_new"))).alias("_map")), outer=True)
    untagged = lambda p: F.regexp_replace(p, f"^[{MALE}{FEMALE}{EITHER}{BARE}]", "")
    back = F.array_join(F.transform("_pieces", lambda p, i: F.coalesce(F.try_element_at("_map", i), untagged(p))), "")
    for code, c in (*tags.items(), ("c", ESCAPE)):
        back = F.regexp_replace(back, ESCAPE + code, c)
    count = F.coalesce(F.size("_map"), F.lit(0)).cast("long")
    replaced = found.join(maps, "_row", "left").select(*[back.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in columns], *([count.alias(count_col)] if count_col else []))
    rest = docs.where(~has).select(*columns, *([F.lit(0).cast("long").alias(count_col)] if count_col else []))
    return rest.unionByName(replaced)
