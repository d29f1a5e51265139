"""Calls through chains of typed receivers (``x().y->z(1)``), resolved for all calls at once by staged joins.

Tables, with names qualified by ``::`` (or another sign):
  classes: name
  members: owner, name, kind (method_def, method_decl, field), type_text, arity_min, arity_max, variadic, chunk_id
  bases: owner, base (as written)
  calls: call_id, cls (the class it stands in), access (null for a bare call, ``.``, ``->`` or ``::``), via (this, type,
    unknown), head (the written type, or the name), steps (array: ``x()``, ``x``, ``[]``, ``->``, ``*``), name, arity

A written name means the class of the innermost scope that has it (the class itself, its bases, then what encloses it),
else every class that ends with it. A member is that of the nearest base, breadth first. A step turns each
call's receivers (classes and a number of pointers) into those of the member's type; a level of steps is one join with
members by class and name, so the loop runs as often as the longest chain has steps. At last the called name is looked
up, and of its rows the definitions that take the arity count, else declarations that do, else all definitions.

What calls share lies in the model: types of members are looked up once, and a class lies in one row with its bases, each
with a signature of its members' names, so that a wanted name meets only the nearest base that may have it. What a call
needs later travels with it.

Outcomes: calling_class, typed, static (the target is known), declaration, no_fit, field; and without a target
global, not_a_class, not_in_class (the classes and their bases are all known, and none has it), no_class, untyped, bare.
A null name of a class, member or call matches nothing; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import keep, sent

MOST_DEPTH = 16
#: Homes of a name up to which they lie in its row; a name of more is tried scope by scope.
MOST_HOMES = 8
#: Members behind the signs of a step.
OPERATORS = {"[]": "operator[]", "->": "operator->", "*": "operator*"}


def scopes(name: Column, sep: str = "::") -> Column:
    """a::b::C gives a::b::C, a::b, a and ''."""
    parts = F.split(name, sep)
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def type_name(text: Column) -> Column:
    """The class a written type names: ``const ns::Box<int>*&`` gives ns::Box; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<.*>", ""), r"\b(?:const|volatile|struct|class|typename|static|mutable)\b", "")
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(bare, r"[*&\s]+", " ")), r"^::", ""), F.lit(""))


def pointers(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.regexp_replace(text, r"<.*>", ""), r"[^*]", ""))


def signature(name: Column) -> Column:
    """One of 64 bits for a name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.crc32(name), F.lit(64)).cast("int"))


def _nearest(up: Column) -> Column:
    """Bases by depth and name, each at its least depth."""
    by_name = F.array_sort(F.transform(up, lambda x: F.struct(x["base"].alias("base"), x["depth"].alias("depth"), x["bits"].alias("bits"), x["lost"].alias("lost"))))
    first = F.filter(by_name, lambda x, i: (i == 0) | (F.get(by_name, i - 1)["base"] != x["base"]))
    return F.array_sort(F.transform(first, lambda x: F.struct(x["depth"].alias("depth"), x["base"].alias("base"), x["bits"].alias("bits"), x["lost"].alias("lost"))))


class Model:
    """The class model's derived tables.

    classes: name; outer: classes around others; ends: name, prefix and class of every way to end a class's name;
    meant: name, homes (the prefixes; null if more than MOST_HOMES) and least (the class of that name, else the first that
    ends with it, and the classes around it); lineage: class, up (itself and its bases by distance, with their names'
    signatures) and open (a base is unknown); members: with the class that their type means, or the name to guess it by.
    """

    def __init__(self, classes: DataFrame, members: DataFrame, bases: DataFrame, sep: str = "::"):
        self.sep = sep
        self.classes = keep(classes.select("name").where("name IS NOT NULL").distinct(), "classes")
        self._names()
        written = bases.select("owner", "base").where("owner IS NOT NULL AND base IS NOT NULL").distinct()
        at = written.select("owner", "base", F.struct("owner", "base").alias("key"), type_name(F.col("base")).alias("name"), F.slice(scopes(F.col("owner"), sep), 2, 1 << 20).alias("scopes"))
        found = self._guessed(self._scoped(at))
        edges = keep(found.select(F.col("owner").alias("class"), F.col("class").alias("base")).where("class <> base").distinct(), "bases")
        members = members.where("owner IS NOT NULL AND name IS NOT NULL")
        self.lineage = self._lineage(edges, found.where("class IS NULL").select("owner").distinct(), members)
        typed = members.dropDuplicates().select("*", F.struct("owner", "type_text").alias("key"), F.col("owner").alias("cls")).withColumnRenamed("name", "member")
        typed = self._scoped(typed.withColumn("name", type_name(F.col("type_text"))))
        typed = typed.select(F.col("owner").alias("holder"), "member", "kind", "arity_min", "arity_max", "variadic", "chunk_id", F.col("class").alias("to"), "guess", pointers(F.col("type_text")).alias("pointers"), F.lit(True).alias("found"))
        self.members = keep(typed, "members")
        self.operators = [r.member for r in self.members.where(F.col("member").isin(*OPERATORS.values())).select("member").distinct().collect()]
        self.guesses = not self.members.where("guess IS NOT NULL").isEmpty()

    def _names(self) -> None:
        ways = self.classes.select(F.col("name").alias("class"), F.posexplode(F.slice(scopes(F.col("name"), self.sep), 2, 1 << 20)).alias("rank", "prefix"))
        self.outer = keep(ways.select(F.col("prefix").alias("name")).distinct().join(self.classes, "name", "left_semi"), "outer")
        ways = ways.join(sent(self.outer, "name").withColumnsRenamed({"name": "prefix"}).withColumn("outer", F.lit(True)), "prefix", "left").withColumn("outer", F.coalesce("outer", F.lit(False)))
        around = keep(ways.where("outer").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "prefix"))), lambda x: x["prefix"]).alias("around")), "around")
        rest = F.substring(F.col("class"), F.char_length("prefix") + F.lit(len(self.sep) + 1), F.char_length("class"))
        ways = ways.select("class", "prefix", "outer", F.when(F.col("prefix") == "", F.col("class")).otherwise(rest).alias("name"))
        self.ends = keep(ways.join(sent(around, "class"), "class", "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>"))), "ends")
        n = F.count("*").over(Window.partitionBy("name"))
        few = F.collect_list(F.when(F.col("n") <= MOST_HOMES, F.struct("prefix", "outer")))
        least = F.min(F.struct((F.col("prefix") != "").alias("ends"), "class", "around"))
        by_name = self.ends.withColumn("n", n).groupBy("name").agg(few.alias("homes"), least.alias("least"))
        self.meant = keep(by_name.select("name", F.when(F.size("homes") > 0, F.col("homes")).alias("homes"), F.struct("least.class", "least.around").alias("least")), "meant")

    def _scoped(self, names: DataFrame) -> DataFrame:
        """names (key, name, others) with class, that of the first scope that has the name, else guess, the name if classes end with it.

        The scopes are their column, else cls is a class (its bases count) or a scope. name and scopes hang on the key alone.
        """
        whole = "scopes" in names.columns
        rows = names if whole else names.withColumn("scopes", scopes(F.coalesce("cls", F.lit("")), self.sep))
        none = F.lit(None).cast("string")
        full = lambda scope, name: F.when(scope == "", name).otherwise(F.concat(scope, F.lit(self.sep), name))
        met = rows.where("name IS NOT NULL").join(self.meant.select("name", "homes", F.lit(True).alias("known")), "name", "left")
        hard = F.col("homes").isNull() if whole else F.col("homes").isNull() | F.exists("homes", lambda h: h["outer"])
        near = F.filter("homes", lambda h: F.array_contains("scopes", h["prefix"]))
        first = F.array_min(F.transform(near, lambda h: F.struct(F.array_position("scopes", h["prefix"]).alias("rank"), h["prefix"].alias("prefix"))))["prefix"]
        met = met.withColumn("hard", F.coalesce(F.col("known") & hard, F.lit(False))).withColumn("class", F.when(~F.col("hard"), full(first, F.col("name"))))
        met = met.withColumn("guess", F.when(F.col("known") & ~F.col("hard") & F.col("class").isNull(), F.col("name"))).drop("homes", "known", *([] if whole else ["scopes"]))
        met = keep(met.unionByName(rows.where("name IS NULL").drop(*([] if whole else ["scopes"])).select("*", F.lit(False).alias("hard"), none.alias("class"), none.alias("guess"))), "scoped")
        easy, todo = met.where("NOT hard").drop("hard"), met.where("hard").drop("hard", "class", "guess")
        if todo.isEmpty():
            return easy
        tried = todo.select("key", "name", *(["scopes"] if whole else ["cls"])).distinct()
        if not whole:
            up = self.lineage.select(F.col("class").alias("cls"), F.transform("up", lambda x: x["base"]).alias("up"))
            tried = tried.join(up, "cls", "left").withColumn("scopes", F.array_distinct(F.concat(F.coalesce("up", F.array().cast("array<string>")), scopes(F.coalesce("cls", F.lit("")), self.sep))))
        tried = tried.select("key", F.posexplode("scopes").alias("rank", "scope"), "name").select("key", "rank", full(F.col("scope"), F.col("name")).alias("class"))
        hit = tried.join(self.classes.select(F.col("name").alias("class")), "class", "left_semi").groupBy("key").agg(F.min_by("class", "rank").alias("class"))
        done = todo.join(hit, "key", "left")
        return easy.unionByName(done.withColumn("guess", F.when(F.col("class").isNull(), F.col("name"))))

    def _guessed(self, scoped: DataFrame) -> DataFrame:
        """Rows whose class is to be guessed, once for each class that ends with the name."""
        kept = keep(scoped, "named")
        if kept.where("guess IS NOT NULL").isEmpty():
            return kept.drop("guess")
        ends = self.ends.where("prefix <> ''").select(F.col("name").alias("guess"), "class")
        return kept.where("guess IS NULL").drop("guess").unionByName(kept.drop("class").join(ends, "guess").drop("guess"))

    def _lineage(self, edges: DataFrame, lost: DataFrame, members: DataFrame) -> DataFrame:
        """class, up and open of each class; known distances double with each round."""
        own = members.select(F.col("owner").alias("class"), signature(F.col("name")).alias("bit")).groupBy("class").agg(F.bit_or("bit").alias("bits"))
        info = self.classes.select(F.col("name").alias("class")).join(own, "class", "left").join(lost.select(F.col("owner").alias("class"), F.lit(True).alias("lost")), "class", "left")
        info = keep(info.select("class", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"), F.coalesce("lost", F.lit(False)).alias("lost")), "infos")
        entry = lambda depth, base: F.struct(F.lit(depth).alias("depth"), F.col(base).alias("base"), "bits", "lost")
        direct = edges.join(info.withColumnRenamed("class", "base"), "base").groupBy("class").agg(F.collect_list(entry(1, "base")).alias("bases"))
        up = info.select("class", F.array(entry(0, "class")).alias("self")).join(direct, "class", "left")
        up = keep(up.select("class", F.when(F.col("bases").isNull(), F.col("self")).otherwise(_nearest(F.concat("self", "bases"))).alias("up")), "lineage")
        step = 1
        while step < MOST_DEPTH:
            far = up.select("class", F.explode(F.filter("up", lambda x: x["depth"] == step)).alias("at")).select("class", F.col("at.base").alias("mid"))  # noqa: B023
            above = F.filter(F.transform("up", lambda x: x.withField("depth", x["depth"] + step)), lambda x: (x["depth"] > step) & (x["depth"] < MOST_DEPTH))  # noqa: B023
            above = up.select(F.col("class").alias("mid"), above.alias("up")).where(F.size("up") > 0)
            more = keep(far.join(above, "mid").select("class", "up"), "above")
            if more.isEmpty():
                break
            up = keep(up.unionByName(more).groupBy("class").agg(F.flatten(F.collect_list("up")).alias("up")).select("class", _nearest(F.col("up")).alias("up")), "lineage")
            step *= 2
        return up.withColumn("open", F.exists("up", lambda x: x["lost"]))

    def named(self, names: DataFrame) -> DataFrame:
        """names (key, name, cls, others) with class, as written in a member of cls; null if none has it, a row each if it is guessed."""
        return self._guessed(self._scoped(names))

    def find(self, wanted: DataFrame, *columns: str) -> DataFrame:
        """Columns of the members of the nearest class that has the name, for (key, class, member, others), with holder and found.

        Classes of a lesser rank (a column, if there is one) go first. A key that has none stays, with open: whether a class or
        base of it is unknown. Others hang on the key alone.
        """
        w = wanted if "rank" in wanted.columns else wanted.withColumn("rank", F.lit(0))
        others = [c for c in w.columns if c not in ("class", "member", "rank")]
        has = self.members.select("holder", "member", "found", *columns)

        def candidates(rows: DataFrame) -> DataFrame:
            met = rows.join(self.lineage, "class", "left").withColumn("bit", signature(F.col("member")))
            met = met.withColumn("near", F.filter("up", lambda x: x["bits"].bitwiseAND(F.col("bit")) != 0)).withColumn("least", F.get("near", F.lit(0))["depth"])
            return met.withColumn("open", F.coalesce("open", F.lit(True))).drop("up", "bit")

        met = candidates(w)
        first = F.filter("near", lambda x: x["depth"] == F.col("least"))
        met = met.select(*others, "rank", "class", "member", "open", "least", (F.size("near") > F.size(first)).alias("deeper"), F.explode_outer(first).alias("at"))
        met = met.select(*others, "rank", "class", "member", "open", F.col("least").alias("depth"), "deeper", F.col("at.base").alias("holder"))
        # rows without a candidate meet nothing, so they stay where they are
        got = met.where("holder IS NOT NULL").join(has, ["holder", "member"], "left")
        got = got.unionByName(met.where("holder IS NULL").select("*", *[F.lit(None).cast(has.schema[c].dataType).alias(c) for c in ("found", *columns)]))
        got = keep(got.withColumn("class", F.when(F.col("found").isNull() & F.col("deeper"), F.col("class"))), "candidates")
        missed = got.where("class IS NOT NULL")
        got = got.drop("class", "deeper")
        if not missed.isEmpty():  # another name of the same bit
            more = candidates(missed.select(*others, "rank", "class", "member").distinct())
            more = more.select(*others, "rank", "member", "open", F.explode(F.filter("near", lambda x: x["depth"] > F.col("least"))).alias("at")).select(*others, "rank", "member", "open", F.col("at.depth").alias("depth"), F.col("at.base").alias("holder"))
            got = got.unionByName(more.join(has, ["holder", "member"]).select(*got.columns))
        near = F.struct("rank", "depth")
        got = got.withColumn("nearest", F.min(F.when(F.col("found"), near)).over(Window.partitionBy("key")))
        got = got.where(F.col("nearest").isNull() | (F.col("found") & (near == F.col("nearest"))))
        lone = lambda c: F.when(F.col("found"), F.col(c)).alias(c)
        return got.select(*others, lone("holder"), F.coalesce("found", F.lit(False)).alias("found"), F.when(F.col("found").isNull(), F.col("open")).alias("open"), *columns).distinct()

    def types(self, hits: DataFrame, *others: str) -> DataFrame:
        """others, class and pointers that the types of found members (with to, guess and pointers) make."""
        out = hits.where("to IS NOT NULL").select(*others, F.col("to").alias("class"), "pointers").distinct()
        if not self.guesses:
            return out
        ends = self.ends.where("prefix <> ''").select(F.col("name").alias("guess"), "class")
        return out.unionByName(hits.where("guess IS NOT NULL").select(*others, "guess", "pointers").distinct().join(ends, "guess").select(*others, "class", "pointers"))


OF_TYPE = ("kind", "to", "guess", "pointers")
OF_CALL = ("kind", "arity_min", "arity_max", "variadic", "chunk_id")
#: What travels with a receiver.
WITH = ("key", "how", "steps", "arrow", "name", "arity")
METHODS = "found AND kind <> 'field'"


def resolve(calls: DataFrame, model: Model) -> DataFrame:
    """call_id, outcome and targets (chunk ids, sorted; null if unknown) of each call."""
    sep = model.sep
    done: list[DataFrame] = []

    def end(keys: DataFrame, outcome: str) -> None:
        done.append(keys.select("key", F.lit(outcome).alias("outcome"), F.lit(None).cast("array<string>").alias("targets")))

    def settle(wanted: DataFrame, otherwise: Callable[[], Column]) -> None:
        done.append(_chosen(model.find(wanted, *OF_CALL), otherwise()))

    missing = lambda: F.when(F.bool_or("open"), "no_class").otherwise("not_in_class")

    # the class a call stands in: as it is written, or a qualifier looked up from outside
    c = calls.where("call_id IS NOT NULL").dropDuplicates(["call_id"]).withColumnRenamed("call_id", "key")
    own = model.meant.select(F.col("name").alias("cls"), F.col("least.class").alias("own"), F.col("least.around").alias("around"))
    at = c.where("cls IS NOT NULL").join(own, "cls", "left").unionByName(c.where("cls IS NULL"), allowMissingColumns=True)
    at = keep(at.withColumn("at", F.coalesce("own", "cls")).drop("cls"), "at")
    inside = lambda df, member, *others: df.where("own IS NOT NULL").select(*others, F.posexplode(F.concat(F.array("own"), "around")).alias("rank", "class"), F.col(member).alias("member"))

    # bare calls
    bare = at.where("access IS NULL").withColumn("how", F.lit("calling_class"))
    settle(inside(bare, "name", "key", "how", "arity"), lambda: F.lit("bare"))
    end(bare.where("own IS NULL"), "bare")

    # X::name(), and ::X() that makes a global class
    static = at.where(F.col("access") == sep).select("key", "at", "head", "name", "arity", F.lit("static").alias("how"))
    plain = static.where("coalesce(head, '') = ''")
    if not plain.isEmpty():
        settle(plain.select("key", "how", "arity", F.col("name").alias("class"), F.col("name").alias("member")), lambda: F.lit("global"))
    typed = static.where("coalesce(head, '') <> ''")
    meant = model.named(typed.select("key", "how", "arity", F.col("name").alias("member"), type_name(F.col("head")).alias("name"), F.col("at").alias("cls"))).drop("name", "cls")
    end(meant.where("class IS NULL"), "not_a_class")
    usual = meant.where("class IS NOT NULL")
    nested = usual.join(sent(model.outer, "name").withColumnsRenamed({"name": "class"}), "class").withColumn("class", F.concat("class", F.lit(sep), "member"))
    nested = keep(nested.join(model.classes.withColumnRenamed("name", "class"), "class", "left_semi"), "nested")
    if not nested.isEmpty():
        settle(nested, lambda: F.lit("not_a_class"))
        usual = usual.join(sent(nested.select("key")), "key", "left_anti")
    settle(usual, missing)

    # a receiver: this, a written type, or a name of the calling class
    dotted = at.where(F.col("access").isin(".", "->")).withColumn("arrow", F.col("access") == "->")
    this = dotted.where("via = 'this'").withColumn("how", F.lit("calling_class"))
    state = this.where("own IS NOT NULL").select(*WITH, F.col("own").alias("class"), F.lit(1).alias("pointers"))
    end(this.where("own IS NULL"), "no_class")
    written = dotted.where("via = 'type' OR via = 'typed'").select("key", F.lit("typed").alias("how"), "steps", "arrow", F.col("name").alias("called"), "arity", type_name(F.col("head")).alias("name"), F.col("at").alias("cls"), pointers(F.col("head")).alias("pointers"))
    meant = model.named(written).drop("name", "cls").withColumnRenamed("called", "name")
    state = state.unionByName(meant.where("class IS NOT NULL").select(*state.columns))
    end(meant.where("class IS NULL"), "no_class")
    unknown = dotted.where("via = 'unknown'").withColumn("how", F.lit("calling_class")).withColumn("call", F.col("head").endswith("()")).withColumn("word", F.regexp_replace("head", r"\(\)$", ""))
    if not unknown.isEmpty():
        made = model.named(unknown.where("call").select(*[x for x in WITH if x != "name"], F.col("name").alias("called"), F.col("word").alias("name"), F.col("at").alias("cls"))).drop("name", "cls").withColumnRenamed("called", "name")
        made = made.where("class IS NOT NULL")
        rest = keep(unknown.join(made.select("key"), "key", "left_anti"), "unmade")
        found = keep(model.find(inside(rest, "word", *WITH, "call"), *OF_TYPE).where("found AND call = (kind <> 'field')"), "head-members")
        types = keep(model.types(found, *WITH), "head-member-types")
        state = state.unionByName(made.select(*WITH, "class", F.lit(0).alias("pointers"))).unionByName(types)
        field = found.join(types, "key", "left_anti").select("key", "call").distinct()
        end(field.where("NOT call"), "no_class")
        end(rest.join(found, "key", "left_anti").select("key").union(field.where("call").select("key")), "untyped")
    end(dotted.where("coalesce(via, '') NOT IN ('this', 'type', 'typed', 'unknown')"), "untyped")

    # steps, one of all calls at a time
    longest = dotted.agg(F.max(F.size("steps")).alias("n")).first().n or 0
    for i in range(longest):
        more = F.coalesce(F.size("steps") > i, F.lit(False))
        going = state.where(more)
        after = keep(_step(model, going.withColumn("step", F.get("steps", F.lit(i)))), "receivers")
        end(going.select("key").distinct().join(after.select("key"), "key", "left_anti"), "no_class")
        state = state.where(~more).unionByName(after)

    # a value reached by -> goes through its operator->
    if OPERATORS["->"] in model.operators:
        state = keep(state, "receivers")
        arrows = state.where("arrow")
        value = arrows.join(arrows.where("pointers > 0").select("key"), "key", "left_anti")
        over = keep(model.find(value.select(*WITH, "class", F.lit(OPERATORS["->"]).alias("member")), *OF_TYPE).where(METHODS), "arrows")
        gives = keep(model.types(over, *WITH), "arrow-types")
        end(over.select("key").distinct().join(gives, "key", "left_anti"), "no_class")
        state = state.join(over.select("key"), "key", "left_anti").unionByName(gives)
    settle(state.select("key", "how", "arity", "class", F.col("name").alias("member")), missing)

    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("key", "call_id")


def _step(model: Model, going: DataFrame) -> DataFrame:
    """Receivers (with all that travels with them) after one step of each call."""
    sign = F.col("step").isin(*OPERATORS)
    less = going.where(sign & (F.col("pointers") > 0)).select(*WITH, "class", (F.col("pointers") - 1).alias("pointers"))
    value = going.where(sign & (F.col("pointers") == 0))
    element = value.where("step = '[]'").select(*WITH, "class", "pointers")  # an array's element has its type
    out = less
    if model.operators:
        of = F.create_map(*[F.lit(x) for kv in OPERATORS.items() for x in kv])
        over = keep(model.find(value.select(*WITH, "class", F.element_at(of, F.col("step")).alias("member")), *OF_TYPE).where(METHODS), "step-operators")
        element = element.join(over.select("key"), "key", "left_anti").select(*element.columns)
        out = out.unionByName(model.types(over, *WITH))
    plain = going.where(~sign).withColumn("call", F.col("step").endswith("()")).withColumn("member", F.regexp_replace("step", r"\(\)$", ""))
    hits = model.find(plain.select(*WITH, "call", "class", "member"), *OF_TYPE)
    both = hits.where("found")
    if OPERATORS["->"] in model.operators:
        lost = hits.where("NOT found").select("key").distinct()
        through = keep(plain.where("pointers = 0").join(lost, "key", "left_semi"), "through")
        arrow = model.types(model.find(through.select(*WITH, "call", F.col("member").alias("then"), "class", F.lit(OPERATORS["->"]).alias("member")), *OF_TYPE).where(METHODS), *WITH, "call", "then")
        both = both.unionByName(model.find(arrow.select(*WITH, "call", "class", F.col("then").alias("member")), *OF_TYPE).where("found"))
    by_member = model.types(both.where("call = (kind <> 'field')"), *WITH)
    return out.unionByName(element).unionByName(by_member)


def _chosen(hits: DataFrame, otherwise: Column) -> DataFrame:
    """key, outcome and targets: of each call's members (key, how, arity, found) those of the best kind that take its arity.

    A definition also takes it if a declaration of the same width does (defaults are written at declarations).
    """
    fits = F.coalesce((F.col("arity") >= F.col("arity_min")) & (F.col("variadic") | (F.col("arity") <= F.col("arity_max"))), F.lit(True))
    wide = F.collect_set(F.when((F.col("kind") == "method_decl") & F.col("fits"), F.struct("arity_max", "variadic"))).over(Window.partitionBy("key"))
    r = hits.withColumn("fits", fits).withColumn("wide", wide)
    same = F.exists("wide", lambda w: w["arity_max"].eqNullSafe(F.col("arity_max")) & w["variadic"].eqNullSafe(F.col("variadic")))
    # 0: a definition that fits, 1: a declaration that does, 2: any definition, 3: any declaration, null: a field
    rank = F.when((F.col("kind") == "method_def") & (F.col("fits") | same), 0).when((F.col("kind") == "method_decl") & F.col("fits"), 1).when(F.col("kind") == "method_def", 2).otherwise(3)
    r = r.withColumn("rank", F.when(F.expr(METHODS), rank)).withColumn("best", F.min("rank").over(Window.partitionBy("key")))
    got = r.groupBy("key").agg(F.bool_or("found").alias("found"), F.min("best").alias("rank"), F.min("how").alias("how"), F.array_sort(F.collect_set(F.when(F.col("rank") == F.col("best"), F.col("chunk_id")))).alias("ids"), otherwise.alias("otherwise"))
    outcome = F.when(~F.col("found"), F.col("otherwise")).when(F.col("rank").isNull(), "field").when(F.col("rank") == 0, F.col("how")).when(F.col("rank") == 1, "declaration").otherwise("no_fit")
    ids = F.col("ids").cast("array<string>")
    return got.select("key", outcome.alias("outcome"), F.when(F.col("found") & (F.col("rank").isNull() | (F.size("ids") > 0)), ids).alias("targets"))
