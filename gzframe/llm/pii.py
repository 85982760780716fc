"""Operator 9: personal data replaced by surrogates, in DataFrame operations only.

One pattern finds e-mail addresses, secrets, card and account numbers, network
addresses, phone numbers, identity numbers and titled names. Every entity gets
a replacement that is a keyed function of its normalised form, so mentions of
one entity agree in all documents; digits stay digits, letters keep case and
script, separators stay, card numbers keep their check digit's validity,
addresses stay in range, names keep title and gender.

Distinct entities (not documents) are then checked for collisions: two
entities with one surrogate, or a surrogate that is a real entity, are drawn
again with the next attempt number until none is left. The values to draw from
grow with the attempt, so entities of one shape may be more than its values:
surnames get a syllable more with each attempt; from attempt ``WIDER`` on,
e-mail addresses, phone and identity numbers and secrets get a letter or digit
more each, and network addresses any octets. The few that needed a
further attempt enter as literals up to ``MAP_ROWS``, beyond by a join.

Defined cases: null text stays null with 0 entities; empty texts stay; texts of
any length are processed whole; the match that begins first is an entity, and of
those that begin together the first kind of the pattern; repeated rows give repeated rows; an empty
table gives an empty result; ``pseudonymise`` keeps further columns whatever
their names: where one is called n_entities or kinds, the result's own gets
underscores before its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gzframe.llm.common import bounded_batches, free_name, written

# Forms of address by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sir", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа")
NEUTRAL = ("Dr", "Prof", "Mx")
# Given names for surrogates, by gender and script.
GIVEN = {
    ("m", "latin"): "Adam Alan Boris Carl David Edgar Felix Georg Henri Ivan Jonas Karl Leon Marco Nils Oscar Paul Rafael Simon Tomas".split(),
    ("f", "latin"): "Ada Alice Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nina Olga Paula Rosa Sofia Vera".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Ирина Клара Лидия Мария".split(),
}
# Syllables of surrogate surnames, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(),
}
# Alphabets from which letters of the same kind are drawn.
ALPHABETS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[0-9]", "0123456789"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшщыэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"[\p{IsLatin}&&\p{Ll}]", "àáâäçèéêëìíîïñòóôöùúûü"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"),
)

TITLES = "|".join(sorted({*MALE, *FEMALE, *NEUTRAL}, key=lambda t: (-len(t), t)))
# the part before @ is tried from its beginning only, and never again in shorter form
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})+"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
# one character is looked at before the longer look behind
SECRET = r"\b(?:AKIA[0-9A-Z]{16}|gh[a-z]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})\b|(?<=[=: \"'])(?=[A-Za-z0-9_+/.-]{8})(?i:(?<=(?:token|secret|password|passwd|api_key|apikey|key)[ ]{0,2}[=:][ ]{0,2}[\"']?))[A-Za-z0-9_+/.-]{8,}"
CARD = r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}(?:[ .-]\d{2,4}){0,3}(?!\d)|\+\d{8,15}\b"
PERSON = rf"(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
NUMERIC = rf"(?=[\d+(])(?:{'|'.join((CARD, ADDRESS, SOCIAL, PHONE))})"
ENTITY = "|".join((EMAIL, SECRET, IBAN, NUMERIC, PERSON))
#: Fixed value: a noncharacter put around entities; texts that hold it are searched twice instead.
MARK = "\ufdd0"

#: Entities with further attempts that are put in the plan as literals.
MAP_ROWS = 200
#: The attempt from which surrogates no longer keep to the length of their entity.
WIDER = 3


def kind_of(e: Column) -> Column:
    full = lambda p: e.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(e, F.lit("@")) & full(EMAIL), "email")
        .when(e.rlike(rf"^(?:{TITLES})\.? "), "person")
        .when(full(r"(?:\d{1,3}\.){3}\d{1,3}"), "address")
        .when(full(r"\d{3}-\d{2}-\d{4}"), "social")
        .when(full(r"(?:\d{4}[ -]?){3}\d{1,7}"), "card")
        .when(full(IBAN), "account")
        .when(full(r"[+(]?[\d .()-]+") | e.startswith("+"), "phone")
        .otherwise("secret")
    )


def normal(e: Column, kind: Column) -> Column:
    """The form in which mentions of one entity are equal."""
    digits = F.regexp_replace(e, r"[ ().-]", "")
    name = F.lower(F.regexp_replace(e, r"\.", ""))
    return F.when(kind == "email", F.lower(e)).when(kind == "person", name).when(kind.isin("card", "phone", "social", "account"), digits).otherwise(e)


def luhn(digits: Column, drop: int) -> Column:
    """Luhn sum modulo 10 of an array of digits, doubling every second one from the right, ``drop`` places still to come."""
    n = F.size(digits)
    picked = F.transform(digits, lambda d, i: F.when((n - 1 - i + drop) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(picked, F.lit(0), lambda a, x: a + x) % 10


def surrogate(e: Column, kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement of mention ``e``; all mentions of equal ``kind`` and ``norm`` share the keyed draws."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 256)
    return F.element_at(F.transform(F.array(F.struct(seed.alias("seed"), attempt.cast("int").alias("attempt"))), lambda s: _drawn(e, kind, s.seed, s.attempt)), 1)


def _drawn(e: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    draw = lambda i, n: F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")

    def letter(c: Column, i: Column, hexes: Column | None = None) -> Column:
        out = None
        for pattern, alphabet in ALPHABETS:
            pick = F.substring(F.lit(alphabet), draw(i, len(alphabet)) + 1, F.lit(1))
            if hexes is not None and pattern in ("[a-z]", "[A-Z]"):
                pick = F.when(hexes, F.substring(F.lit(alphabet), draw(i, 6) + 1, F.lit(1))).otherwise(pick)
            out = F.when(c.rlike(f"^{pattern}$"), pick) if out is None else out.when(c.rlike(f"^{pattern}$"), pick)
        return out.otherwise(c)

    def shaped(text: Column, hexes: Column | None = None) -> Column:
        # the n-th letter or digit is drawn for its number, so separators do not change the draws
        chars = F.split(text, "")
        ranks = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"[^\p{L}\p{N}]", "")))
        return F.array_join(F.zip_with(chars, ranks, lambda c, r: letter(c, r, hexes)), "")

    def more(n: Column, first: int, values: Column) -> Column:
        # n further draws from an array, none for the usual first attempt
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(values, F.pmod(F.xxhash64(seed, i + first), F.size(values)).cast("int") + 1)), "")).otherwise("")

    listed = lambda values: F.array(*map(F.lit, values))
    longer = attempt - (WIDER - 1)
    digits = more(longer, 100_000, listed("0123456789"))
    tail = F.regexp_extract(e, r"\.[^.@]+$", 0)
    email = F.concat(more(longer, 100_000, listed("abcdefghijklmnopqrstuvwxyz")), shaped(F.substring(e, F.lit(1), F.length(e) - F.length(tail))), tail)
    code = F.regexp_extract(e, r"^\+\d{1,3}(?=\D)", 0)
    phone = F.concat(code, shaped(F.substring(e, F.length(code) + 1, F.length(e))), digits)
    octet = lambda o, i: F.when(longer > 0, draw(i, 256)).when(F.length(o) >= 3, 100 + draw(i, 156)).when(F.length(o) == 2, 10 + draw(i, 90)).otherwise(draw(i, 10)).cast("string")
    address = F.array_join(F.transform(F.split(e, r"\."), octet), ".")
    digits_of = lambda x: F.transform(F.split(F.regexp_replace(x, r"\D", ""), ""), lambda c: c.cast("int"))
    plain = shaped(e)
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    card = F.when(luhn(digits_of(e), 0) == 0, F.concat(body, ((10 - luhn(digits_of(body), 1)) % 10).cast("string"))).otherwise(plain)
    secret = F.concat(shaped(e, e.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), digits)
    account = F.concat(F.substring(e, 1, 2), shaped(F.substring(e, F.lit(3), F.length(e))))

    title = F.regexp_extract(e, rf"^(?:{TITLES})\.? ", 0)
    names = F.substring(e, F.length(title) + 1, F.length(e))
    cyrillic = names.rlike(r"\p{IsCyrillic}")

    def of_script(script: str) -> Column:
        given = lambda g: F.element_at(F.array(*map(F.lit, GIVEN[g, script])), draw(F.lit(101), len(GIVEN[g, script])) + 1)
        male, female = (title.rlike(rf"^(?:{'|'.join(t)})\b") for t in (MALE, FEMALE))
        first = F.when(male, given("m")).when(female, given("f")).when(draw(F.lit(100), 2) == 0, given("m")).otherwise(given("f"))
        part = lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), draw(F.lit(k), len(SYLLABLES[script])) + 1)
        last = F.initcap(F.concat(part(102), part(103), part(104), more(attempt, 104, listed(SYLLABLES[script]))))
        return F.when(F.contains(names, F.lit(" ")), F.concat(first, F.lit(" "), last)).otherwise(last)

    person = F.concat(title, F.when(cyrillic, of_script("cyrillic")).otherwise(of_script("latin")))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "address", address).when(kind == "card", card).when(kind == "account", account).when(kind == "person", person).when(kind == "social", F.concat(plain, digits)).otherwise(secret)


def pieces(text: Column) -> Column:
    """What stands before, in and between the entities of ``text`` and after them: entities are the pieces of odd number."""
    marked = F.split(F.regexp_replace(text, f"({ENTITY})", f"{MARK}$1{MARK}"), MARK, -1)
    # zip to one array; the last piece has no entity after it
    twice = F.flatten(F.zip_with(F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), 0), lambda a, b: F.array(a, b)))
    return F.when(F.contains(text, F.lit(MARK)), F.filter(twice, lambda x: x.isNotNull())).otherwise(marked)


def entities(parts: Column) -> Column:
    """struct<e, kind, norm> of each entity."""
    found = F.filter(parts, lambda x, i: i % 2 == 1)
    kinds = F.transform(found, lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x.e.alias("e"), x.kind.alias("kind"), normal(x.e, x.kind).alias("norm")))


def attempts(docs: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogates collide, with the attempt at which none does."""
    mentions = docs.select(F.explode(entities(pieces(F.col("text")))).alias("x")).select("x.*")
    each = mentions.groupBy("kind", "norm").agg(F.min("e").alias("e"))
    each = written(each, "pii-entities")
    real = each.select("kind", "norm")

    def drawn(x: DataFrame) -> DataFrame:
        s = surrogate(F.col("e"), F.col("kind"), F.col("norm"), F.col("attempt"), key)
        return x.withColumn("to", normal(s, F.col("kind")))

    now = drawn(each.withColumn("attempt", F.lit(0)))
    for k in range(1, 40):
        w = Window.partitionBy("kind", "to").orderBy("attempt", "norm")
        taken = now.join(real.select("kind", F.col("norm").alias("to"), F.lit(True).alias("is_real")), ["kind", "to"], "left")
        marked = written(taken.withColumn("bad", F.col("is_real").isNotNull() | (F.row_number().over(w) > 1)).drop("is_real"), "pii-draws")
        if not marked.where("bad").limit(1).count():
            return marked.where("attempt > 0").select("kind", "norm", "attempt")
        good = marked.where("not bad").drop("bad")
        now = good.unionByName(drawn(marked.where("bad").drop("bad", "to").withColumn("attempt", F.lit(k))).select(*good.columns))
    raise RuntimeError("surrogates did not become distinct")


def pseudonymise(docs: DataFrame, key: str = "gzframe") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and two columns more: n_entities and kinds (distinct, sorted, comma-joined)."""
    bounded_batches(docs.sparkSession)
    parts, found, to, row, count, kinds = (free_name(docs, c) for c in ("_parts", "_entities", "_to", "_row", "n_entities", "kinds"))
    again = attempts(docs, key)
    few = again.limit(MAP_ROWS + 1).collect()
    base = docs.withColumn(parts, pieces(F.col("text")))
    base = base.withColumn(found, F.when(F.size(parts) > 1, entities(F.col(parts))))
    if len(few) <= MAP_ROWS:
        tries = F.create_map(*[v for r in few for v in (F.lit(f"{r.kind}\x1f{r.norm}"), F.lit(r.attempt))]) if few else None
        attempt = lambda x: F.coalesce(tries[F.concat_ws("\x1f", x.kind, x.norm)], F.lit(0)) if few else F.lit(0)
        base = base.withColumn(to, F.transform(found, lambda x: surrogate(x.e, x.kind, x.norm, attempt(x), key)))
    else:
        # only rows with an entity that was drawn again get anything from the join
        base = written(base.withColumn(row, F.monotonically_increasing_id()), "pii-rows")
        each = base.where(F.col(found).isNotNull()).select(F.col(row).alias("row"), F.posexplode(found).alias("at", "x")).select("row", "at", "x.kind", "x.norm")
        tries = each.join(again, ["kind", "norm"]).groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("at", "attempt"))).alias(to))
        base = base.join(tries, row, "left").drop(row)
        base = base.withColumn(to, F.transform(found, lambda x, i: surrogate(x.e, x.kind, x.norm, F.coalesce(F.element_at(to, i), F.lit(0)), key)))
    joined = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.get(F.col(to), ((i - 1) / 2).cast("int"))).otherwise(x)), "")
    out = base.withColumns(
        {
            count: F.greatest(F.coalesce(F.size(found), F.lit(0)), F.lit(0)).cast("long"),
            kinds: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x.kind))), ","), F.lit("")),
            "text": F.when(F.col(to).isNotNull(), joined).otherwise(F.col("text")),
        }
    )
    return out.drop(parts, found, to)
