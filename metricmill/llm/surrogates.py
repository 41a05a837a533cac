"""Personal data replaced by surrogates of the same kind and form, with DataFrame operations only.

Detection is one regular expression. Every entity has one or more parts (an e-mail address a local part
and a domain, a name given names and a surname), each part a type and a canonical form, so that the
same person, number or address gets the same surrogate wherever and however it is written. A surrogate
is drawn from a keyed digest of type, canonical form and attempt. Draws that two parts share, or that
are themselves a part found in the texts, are drawn again until all differ. Only entities are shuffled
for this; of the texts only those that hold an entity are, once, when the surrogates are put in.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmill.llm.common import apart
from metricmill.session import scratch, stage

_EDGE = "(?<![0-9A-Za-z])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
MALE = "Mr|Herr|Señor|Monsieur|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mme|г-жа|госпожа"
_TITLE = rf"(?:{FEMALE}|{MALE})\.? (?=\p{{Lu}})"
# A possessive 's is not part of a name.
_WORD = r"\p{Lu}(?:\p{L}++|(?=['-]\p{L}{2}))(?:['-](?!s(?!\p{L}))\p{L}++)*+"
_INITIALS = r"(?:(?:\p{Lu}\.)++ ?|\p{Lu} )*+"
# Marks an untitled mention, which is known as mark, sorts of its words, mark, text.
MARK = "\u0001"

# What is looked for, in this order at every place.
PATTERNS = {
    "email": rf"{_EDGE}[A-Za-z0-9][A-Za-z0-9._+-]{{0,63}}+@(?:[A-Za-z0-9-]{{1,63}}+\.){{1,8}}[A-Za-z]{{2,24}}(?![0-9A-Za-z])",
    "secret": rf"{_EDGE}(?i:password|passwd|secret|token|api_key|apikey)[\"']? ?[=:] ?[\"']?[0-9A-Za-z_/+-]{{8,128}}+",
    "key": rf"{_EDGE}AKIA[0-9A-Z]{{12,28}}(?![0-9A-Za-z])",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{3,7}}(?: ?[0-9A-Z]{{1,3}})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "phone": (
        r"(?<![0-9A-Za-z+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
        r"|\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}"
        r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9])"
    ),
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z])",
    "card": rf"{_EDGE}(?:[0-9]{{4}}[ -]?){{3}}[0-9]{{1,7}}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}}){_TITLE}(?:{_INITIALS}{_WORD}(?: (?!{_TITLE}){_INITIALS}{_WORD})*+(?: (?:\p{{Lu}}\.)++)*+|(?:\p{{Lu}}\.)++(?: (?:\p{{Lu}}\.)++)*+)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# No entity without a digit, an @, an equals sign or colon, or a title.
HINT = rf"[0-9@=]|(?i:token|secret|pass|key)[^ ]{{0,6}} ?:|{_TITLE}"

# What surrogate names are made of.
SYLLABLES = {
    "latin": ["ba", "den", "fer", "gal", "hol", "jor", "kel", "lan", "mor", "nes", "pol", "ros", "sal", "tor", "vin", "wes"],
    "cyrillic": ["ба", "ден", "фер", "гал", "хол", "жор", "кел", "лан", "мор", "нес", "пол", "рос", "сал", "тор", "вин", "зес"],
}
ENDINGS = {
    ("male", "latin"): "o", ("female", "latin"): "a", ("family", "latin"): "er",
    ("male", "cyrillic"): "ий", ("female", "cyrillic"): "ия", ("family", "cyrillic"): "ко",
}
# Draws in the entity's own form; after them every second attempt makes the surrogate a character longer.
ATTEMPTS = 8
# What surrogate initials are drawn from.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"


def find(text: Column) -> Column:
    """All entities of a text in order of place; an empty array for null."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text.rlike(HINT), F.lit(False)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def names(entities: Column) -> Column:
    """The different words of the titled names among a text's entities, each after its sort: m or f (given names), s (surname)."""

    def words(entity: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(entity, rf"^(?:{FEMALE}|{MALE})\.? ", ""), F.lit(_WORD), F.lit(0))
        given = F.array_repeat(F.when(entity.rlike(rf"^(?:{MALE})\.? "), "m").otherwise("f"), F.size(found) - 1)
        return F.zip_with(found, F.concat(given, F.array(F.lit("s"))), lambda w, sort: F.concat(sort, w))

    titled = F.filter(entities, lambda e: e.rlike(f"^{_TITLE}"))
    # A name of initials only has no word.
    return F.filter(F.array_distinct(F.flatten(F.transform(titled, words))), lambda x: x.isNotNull())


def mentions(known: Column) -> Column:
    """Regular expression for the words of ``known`` and the initials between them, the longest words first."""
    distinct = F.array_distinct(F.transform(known, lambda x: F.substr(x, F.lit(2))))
    longest = F.array_sort(distinct, lambda a, b: F.length(b) - F.length(a))
    word = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))
    return F.concat(word, F.lit(rf"(?: {_INITIALS}"), word, F.lit(")*+"))


def marked(entities: Column, known: Column) -> Column:
    """Entities that are untitled mentions of ``known`` names in their marked form, the others as they are."""

    def sorts(entity: Column) -> Column:
        found = F.regexp_extract_all(entity, F.lit(_WORD), F.lit(0))
        own = F.transform(found, lambda w: F.filter(known, lambda x: F.substr(x, F.lit(2)) == w)[0])
        return F.array_join(F.transform(own, lambda x: F.left(x, F.lit(1))), "", "s")

    return F.transform(
        entities,
        lambda e: F.when(e.rlike(f"^(?:{ANY})$"), e).otherwise(F.concat(F.lit(MARK), sorts(e), F.lit(MARK), e)),
    )


def kind(entity: Column) -> Column:
    """The type of an entity that ``find`` returned."""
    out = F.when(entity.startswith(MARK), "mention")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum of a text of digits whose last is the check digit."""
    d = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(transform(sequence(0, length({digits}) - 1), i -> if(i % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0))), 0, (a, b) -> a + b)"


def _plain(entity: str) -> str:
    """SQL for a name without its title, or a mention's text."""
    return rf"if({entity} like '{MARK}%', substring_index({entity}, '{MARK}', -1), regexp_replace({entity}, r'^(?:{FEMALE}|{MALE})\.? ', ''))"


def parts(found: DataFrame) -> DataFrame:
    """(entity, kind) to (entity, kind, no, type, canonical): what of an entity is replaced, and how it is known.

    A number of 12 to 19 digits that fails the check-digit test is no card; it has no parts and stays.
    """
    words = f"regexp_extract_all({_plain('entity')}, r\"{_WORD}\", 0)"
    given = rf"array_repeat(if(entity rlike r'^(?:{MALE})\.? ', 'm', 'f'), size({words}) - 1)"
    sorts = f"if(kind = 'mention', split(substring_index(substr(entity, 2), '{MARK}', 1), ''), concat({given}, array('s')))"
    script = "if(w rlike r'^\\p{IsCyrillic}', 'cyrillic', 'latin')"
    sort = "CASE sort WHEN 'm' THEN 'male ' WHEN 'f' THEN 'female ' ELSE 'family ' END"
    named = f"zip_with({words}, {sorts}, (w, sort) -> struct(concat({sort}, {script}) as type, lower(w) as canonical))"
    one = "array(struct({} as type, {} as canonical))"
    lists = f"""CASE kind
        WHEN 'email' THEN array(struct('local' as type, lower(entity) as canonical),
                                struct('domain' as type, lower(substring_index(entity, '@', -1)) as canonical))
        WHEN 'secret' THEN {one.format("'secret'", "regexp_extract(entity, '[0-9A-Za-z_/+-]+$', 0)")}
        WHEN 'key' THEN {one.format("'key'", "entity")}
        WHEN 'iban' THEN {one.format("'iban'", "replace(entity, ' ', '')")}
        WHEN 'ip' THEN {one.format("'ip'", "entity")}
        WHEN 'phone' THEN {one.format("'phone'", f"if(entity like '+%' and entity not like '+1%', concat('+', {_digits('entity')}), right({_digits('entity')}, 10))")}
        WHEN 'ssn' THEN {one.format("'ssn'", _digits('entity'))}
        WHEN 'card' THEN if({_luhn(_digits('entity'))} % 10 = 0 and length({_digits('entity')}) >= 13, {one.format("'card'", _digits('entity'))}, null)
        WHEN 'name' THEN if(size({words}) > 0, {named}, {one.format("'initials'", "md5(entity)")})
        WHEN 'mention' THEN {named}
        END"""
    return found.selectExpr("entity", "kind", f"posexplode({lists}) as (no, part)").selectExpr(
        "entity", "kind", "no", "part.type as type", "part.canonical as canonical"
    )


def draw(key: str) -> Column:
    """A surrogate for (type, canonical, attempt), from a keyed digest.

    From attempt ATTEMPTS on it is longer than its form: letters or digits are added, to an address an octet.
    """
    seed = f"concat_ws('|', '{key}', type, canonical, attempt)"
    byte = "cast(conv(substr(hexes, 1 + 2 * ({} % 128), 2), 16, 10) as int)"
    hexes = f"concat(sha2({seed}, 256), sha2(concat({seed}, '.'), 256), sha2(concat({seed}, ':'), 256), sha2(concat({seed}, ';'), 256))"

    def shaped(text: str, keep: str = "0") -> str:
        """Every letter and digit after the first ``keep`` characters replaced by one of its sort."""
        b = byte.format("i")
        return f"""array_join(transform(split({text}, ''), (c, i) -> CASE
            WHEN i < {keep} THEN c
            WHEN c rlike '[1-9]' THEN cast(1 + {b} % 9 as string)
            WHEN c = '0' THEN cast({b} % 10 as string)
            WHEN c rlike '[a-f]' AND type = 'secret' THEN substr('abcdef', 1 + {b} % 6, 1)
            WHEN c rlike '[A-F]' AND type = 'secret' THEN substr('ABCDEF', 1 + {b} % 6, 1)
            WHEN c rlike '[a-z]' THEN substr('abcdefghijklmnopqrstuvwxyz', 1 + {b} % 26, 1)
            WHEN c rlike '[A-Z]' THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {b} % 26, 1)
            ELSE c END), '')"""

    def syllables(script: str) -> str:
        listed = "array(" + ", ".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        made = f"initcap(array_join(transform(sequence(0, 1 + attempt div 2), i -> element_at({listed}, 1 + {byte.format('i')} % {len(SYLLABLES[script])})), ''))"
        ending = "CASE " + " ".join(f"WHEN type = '{w} {s}' THEN '{e}'" for (w, s), e in ENDINGS.items() if s == script) + " END"
        return f"concat({made}, {ending})"

    def more(alphabet: str) -> str:
        """What makes a surrogate longer; empty for the first attempts."""
        b = byte.format("(127 - i)")
        return f"""if(attempt < {ATTEMPTS}, '', array_join(transform(sequence(0, greatest(0, (attempt - {ATTEMPTS}) div 2)),
            i -> substr('{alphabet}', 1 + {b} % {len(alphabet)}, 1)), ''))"""

    small, digits = more("abcdefghijklmnopqrstuvwxyz"), more("123456789")
    card = shaped("substr(canonical, 1, length(canonical) - 1)", "1")
    octets = ", ".join(f"cast(1 + {byte.format(i)} % 254 as string)" for i in range(4))
    return F.expr(f"""CASE
        WHEN type = 'local' THEN concat({small}, {shaped("substring_index(canonical, '@', 1)")})
        WHEN type = 'domain' THEN concat({small}, {shaped("left(canonical, length(canonical) - length(substring_index(canonical, '.', -1)))")}, substring_index(canonical, '.', -1))
        WHEN type = 'key' THEN concat({shaped('canonical', '4')}, {more("ABCDEFGHIJKLMNOPQRSTUVWXYZ")})
        WHEN type = 'iban' THEN concat({shaped('canonical', '2')}, {digits})
        WHEN type = 'ip' THEN concat_ws('.', {octets}, nullif({digits}, ''))
        WHEN type = 'phone' THEN {shaped('canonical', "if(canonical like '+%', 3, 0)")} || {digits}
        WHEN type = 'card' THEN concat({card}, {digits})
        WHEN type like '%latin' THEN {syllables('latin')}
        WHEN type like '%cyrillic' THEN {syllables('cyrillic')}
        WHEN type = 'ssn' THEN concat({shaped('canonical')}, {digits})
        ELSE concat({small}, {shaped('canonical')}) END""".replace("hexes", hexes))


def _checked(drawn: DataFrame) -> DataFrame:
    """Card numbers get their check digit: the sum with a zero there tells what is missing to a multiple of ten."""
    digits = "concat(surrogate, '0')"
    full = f"concat(surrogate, cast((10 - {_luhn(digits)} % 10) % 10 as string))"
    return drawn.withColumn("surrogate", F.expr(f"if(type = 'card', {full}, surrogate)"))


def assign(known: DataFrame, key: str) -> DataFrame:
    """(type, canonical) to (type, canonical, surrogate), all surrogates of a type different and none a known part.

    Each round draws for the parts that have no surrogate yet; of those that draw the same the first by
    canonical form keeps it, unless it was given in an earlier round or is itself a known part. A local
    part is compared together with its domain's canonical form. A form that has more parts than there are
    surrogates is left for longer ones after ATTEMPTS rounds, so every part is served.
    """
    compared = F.when(F.col("type") == "local", F.concat("surrogate", F.lit("@"), F.substring_index("canonical", "@", -1)))
    compared = F.coalesce(compared, F.lower("surrogate"))
    real = known.select(F.col("type").alias("t"), F.lower("canonical").alias("c"))
    open_, given = known, None
    for attempt in count():
        drawn = _checked(open_.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", draw(key)))
        drawn = drawn.withColumn("compared", compared)
        taken = real if given is None else real.union(given.select("type", "compared"))
        fresh = drawn.join(taken, (drawn["type"] == F.col("t")) & (drawn["compared"] == F.col("c")), "left_anti")
        won = fresh.groupBy("type", "compared").agg(F.min(F.struct("canonical", "surrogate")).alias("w"))
        won = stage(won.selectExpr("type", "w.canonical as canonical", "w.surrogate as surrogate", "compared"))
        given = won if given is None else stage(given.union(won))
        open_ = stage(open_.join(won.select("type", "canonical"), ["type", "canonical"], "left_anti"))
        if open_.isEmpty():
            break
    return given.select("type", "canonical", "surrogate")


def render(entity: str = "entity", kind: str = "kind", made: str = "made", last: str = "''", key: str = "surrogates") -> Column:
    """The surrogate written the way the entity is; ``made`` holds its parts' surrogates in order.

    An initial becomes another letter, drawn from a digest of the letter and ``last``, the last word of the name.
    """
    first = f"element_at({made}, 1)"

    def filled(sort: str, text: str, values: str) -> str:
        """Characters of a sort in ``text`` replaced by those in ``values``, in order, case kept; further ones follow."""
        at = f"length(regexp_replace(substr({text}, 1, i + 1), '[^{sort}]', ''))"
        return (
            f"concat(array_join(transform(split({text}, ''), (c, i) -> if(c rlike '[{sort}]', "
            f"if(c rlike '[a-z]', lower(substr({values}, {at}, 1)), substr({values}, {at}, 1)), c)), ''), "
            f"substr({values}, 1 + length(regexp_replace({text}, '[^{sort}]', ''))))"
        )

    title = f"regexp_extract({entity}, r'^(?:{FEMALE}|{MALE})\\.? ', 0)"
    def initial(letters: str) -> str:
        drawn = f"cast(conv(substr(sha2(concat_ws('|', '{key}', 'initial', p, {last}), 256), 1, 7), 16, 10) as int)"
        at = f"locate(p, '{letters}')"
        return f"substr('{letters}', 1 + if({at} = 0, {drawn} % {len(letters)}, ({at} + {drawn} % {len(letters) - 1}) % {len(letters)}), 1)"

    letter = f"if(p rlike r'^\\p{{IsCyrillic}}', {initial(CAPITALS[1])}, {initial(CAPITALS[0])})"
    between = f"split({_plain(entity)}, r\"{_WORD}\", -1)"  # initials stand there
    lettered = f"array_join(transform(split(t, ''), p -> if(p rlike r'^\\p{{Lu}}', {letter}, p)), '')"
    words = f"if(size({between}) > 1, concat({made}, array('')), array(''))"
    named = f"concat({title}, array_join(zip_with({between}, {words}, (t, w) -> concat({lettered}, w)), ''))"
    secret = f"concat(regexp_extract({entity}, '^(.*?)[0-9A-Za-z_/+-]+$', 1), {first})"
    domain, local = f"element_at({made}, 2)", f"substring_index({entity}, '@', 1)"
    # A longer surrogate has its additional characters in front.
    own = "substr({1}, i + 1 + length({1}) - length({0}), 1)"
    cased = f"concat(left({{1}}, length({{1}}) - length({{0}})), array_join(transform(split({{0}}, ''), (c, i) -> if(c rlike '[A-Z]', upper({own}), {own})), ''))"
    tail = f"substring_index({entity}, '@', -1)"
    phone = f"if({entity} like '+1%', concat('+1', {filled('0-9', f'substr({entity}, 3)', first)}), {filled('0-9', entity, f'''replace({first}, '+', '')''')})"
    return F.expr(f"""CASE {kind}
        WHEN 'email' THEN concat({cased.format(local, first)}, '@', {cased.format(tail, domain)})
        WHEN 'secret' THEN {secret}
        WHEN 'iban' THEN {filled('0-9A-Z', entity, first)}
        WHEN 'phone' THEN {phone}
        WHEN 'ssn' THEN {filled('0-9', entity, first)}
        WHEN 'card' THEN {filled('0-9', entity, first)}
        WHEN 'name' THEN {named}
        WHEN 'mention' THEN {named}
        ELSE {first} END""")


def replacements(lists: DataFrame, key: str) -> DataFrame:
    """(entities) to (entities, made): for every list of entities the list of what replaces them."""
    entities = lists.select(F.explode(F.array_distinct("entities")).alias("entity")).distinct()
    found = stage(parts(entities.withColumn("kind", kind(F.col("entity")))))
    given = assign(stage(found.select("type", "canonical").distinct()), key)
    made = found.join(given, ["type", "canonical"]).groupBy("entity", "kind").agg(
        F.sort_array(F.collect_list(F.struct("no", "surrogate", "canonical"))).alias("list")  # as many as a name has words
    )
    made = made.withColumn("made", F.col("list.surrogate")).withColumn("last", F.element_at("list.canonical", -1))
    made = made.select("entity", render(last="last", key=key).alias("new"))
    placed = lists.withColumn("list", F.md5(F.to_json("entities")))
    placed = placed.select("list", F.posexplode("entities").alias("no", "entity"))
    placed = placed.join(made, "entity", "left").select("list", "no", F.coalesce("new", "entity").alias("new"))
    # As many rows as one text has entities.
    return placed.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("no", "new"))).alias("l")).selectExpr(
        "list as __pii_list", "l.new as __pii_new"
    )


def pseudonymize(docs: DataFrame, text: str = "text", key: str = "surrogates", marks: bool = False) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; all other columns and all rows unchanged.

    Found are e-mail addresses, telephone numbers, IP addresses, card numbers (with a valid check digit),
    bank accounts, social security numbers, titled names with all their words and initials, words of these
    names wherever they stand in the same text, and credentials. Replaced are letters by letters
    of the same case, digits by digits, names by names of the same gender and script; separators, country
    codes, the top domain, the card's first digit and its valid check digit stay. The same entity, in whatever
    spelling, has one surrogate in all texts, different entities have different ones; another ``key`` gives
    others. Null texts stay null; texts without an entity are not touched or shuffled; very long texts are
    searched whole; repeated rows stay alike; an empty table gives an empty result. With ``marks`` the number of replaced entities is added as ``n_entities``.
    """
    all_names = docs.columns
    docs, (text,) = apart(docs, text)
    value = F.col(f"`{text}`").cast("string")
    # Searching costs most by far: texts are searched once and written with what was found.
    found = docs.withColumn("__pii", find(value))
    path = scratch(docs.sparkSession, "pii")
    found.write.parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    # Texts with titled names are searched once more, for other mentions of these.
    named = F.size("__pii_names") > 0
    hit = found.where(F.size("__pii") > 0).withColumn("__pii_names", names(F.col("__pii")))
    hit = hit.withColumn("__pii_any", F.when(named, F.concat(F.lit(f"{ANY}|"), mentions(F.col("__pii_names")))).otherwise(F.lit(ANY)))
    again = marked(F.regexp_extract_all(value, F.col("__pii_any"), F.lit(0)), F.col("__pii_names"))
    hit = hit.withColumn("__pii", F.when(named, again).otherwise(F.col("__pii")))
    lists = stage(hit.select(F.col("__pii").alias("entities")).distinct())
    new = replacements(lists, key)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = found.where(F.size("__pii") == 0).select(*columns, F.lit(0).cast("long").alias("__pii_n"))
    hit = hit.withColumn("__pii_key", F.md5(F.to_json("__pii")))
    hit = hit.join(new, F.col("__pii_key") == F.col("__pii_list"))
    between = F.split(F.col(f"`{text}`"), F.col("__pii_any"), -1)
    whole = F.array_join(
        F.flatten(F.zip_with(between, F.concat("__pii_new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), ""
    )
    changed = [whole.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    count = F.size(F.filter(F.arrays_zip("__pii", "__pii_new"), lambda x: x["__pii"] != x["__pii_new"]))
    out = rest.union(hit.select(*changed, count.cast("long").alias("__pii_n")))
    return out.toDF(*all_names, "n_entities") if marks else out.drop("__pii_n").toDF(*all_names)
