"""Names against a closed roster, and duplicates within one: rules with confidences, as Columns over candidate joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_tokens, normalize_name, significant_tokens
from ..sinks.shared import written

# Full first names by nickname, those of the smaller table, particles of last names, names of rules.
NICKNAMES = {
    "alex": "alejandro", "javi": "javier", "fer": "fernando", "nando": "fernando", "facu": "facundo", "roro": "rodrigo",
    "rubo": "ruben", "yusi": "youssef", "pepe": "jose", "paco": "francisco", "francis": "francisco", "kiko": "francisco",
    "toni": "antonio", "rafa": "rafael", "manu": "manuel", "chus": "jesus", "dani": "daniel", "kike": "enrique",
    "quique": "enrique", "cuti": "cristian", "nico": "nicolas", "julen": "julian", "yago": "santiago", "iago": "santiago",
    "peio": "pedro", "luismi": "luis", "luiz": "luis", "johnny": "john", "robert": "roberto", "rober": "roberto",
}
FEWER_NICKNAMES = {
    "alex": "alejandro", "javi": "javier", "fer": "fernando", "nando": "fernando", "facu": "facundo", "roro": "rodrigo",
    "rubo": "ruben", "yusi": "youssef", "pepe": "jose", "paco": "francisco", "toni": "antonio", "rafa": "rafael",
    "rafaelo": "rafael", "manu": "manuel", "chus": "jesus",
}
ALIAS, UNIQUE, SUBSET_INVERSE, SUBSET_CANON = "first-name-alias-same-lastname", "last-name-unique", "subset-inverse", "subset-canon"
PARTICLES = ["de", "del", "la", "las", "los", "y", "san", "santa"]


def first_name(c: Column, nicknames: dict[str, str] = NICKNAMES) -> Column:
    """The full form of a normalised first name."""
    names = F.create_map(*(F.lit(x) for pair in nicknames.items() for x in pair))
    return F.coalesce(F.try_element_at(names, c), c)


def same_first_name(a: Column, b: Column) -> Column:
    """Equal, one a nickname of the other, or one the other's initial; false if either is missing."""
    same = (first_name(a) == first_name(b)) | ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))
    return F.coalesce((a != "") & (b != "") & same, F.lit(False))


def last_name_length(tokens: Column) -> Column:
    """Tokens of the last name: back from the last but one over particles to the first other token, inclusive."""
    n = F.size(tokens)
    turned = F.slice(F.reverse(tokens), F.lit(2), F.greatest(n - 1, F.lit(0)))
    run = F.aggregate(turned, F.struct(F.lit(1).alias("k"), F.lit(True).alias("open")), lambda a, t: F.struct(F.when(a["open"], a["k"] + 1).otherwise(a["k"]).alias("k"), (a["open"] & t.isin(PARTICLES)).alias("open")))
    return F.when(n <= 1, n).otherwise(run["k"])


def token_holders(names: DataFrame, tokens: str) -> DataFrame:
    """team, token, holders: how many names of a team have a token. names: team and an array of tokens."""
    return names.select("team", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("team", "token").agg(F.count(F.lit(1)).alias("holders"))


def with_rarest(names: DataFrame, key: str, tokens: str, holders: DataFrame) -> DataFrame:
    """names with rarest: of its tokens (which follow from key) the one that the fewest of holders have, ties by token;
    null if a token has no holder at all, for then no name of theirs has all tokens."""
    each = names.select("team", key, tokens).distinct().select("team", key, F.explode(F.array_distinct(tokens)).alias("token")).join(holders.hint("merge"), ["team", "token"], "left")
    best = each.groupBy("team", key).agg(F.min(F.struct(F.coalesce("holders", F.lit(0)).alias("n"), "token")).alias("_r"))
    found = best.select("team", key, F.when(F.col("_r.n") > 0, F.col("_r.token")).alias("rarest"))
    return names.join(found.hint("merge"), ["team", key], "left")


def _keys(*groups: Column) -> Column:
    """Some arrays of keys in one, without nulls."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in groups)), lambda k: k.isNotNull()))


def _meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one team with a common key (of lkeys and rkeys), each once: at its first common key."""
    a, b = left.withColumn("_k", F.explode("lkeys")), right.withColumn("_k", F.explode("rkeys"))
    # rows with keys spread are many times the files that a broadcast is judged by
    return a.join(b.hint("merge"), ["team", "_k"]).where(F.get(F.array_intersect("lkeys", "rkeys"), 0) == F.col("_k")).drop("_k", "lkeys", "rkeys")


def _indexed(left: DataFrame, right: DataFrame, first: Column, case_keys: list[Column], roster_keys: list[Column]) -> DataFrame:
    """Pairs that a rule can hold for. left: team, name, norm, inc, ...; right: team, player, cnorm, canon, ...

    Each rule has its own keys. Equal names: the name. Same last name and first names alike: the last name with the full
    first name, or with the initial where one has no more. Subsets: the rarest token of the smaller name, looked up
    among the tokens of the larger. So a token that a whole team has brings nobody together who have nothing else in
    common that a rule asks for. first: what stands for the first name of a case."""
    inc, canon = F.col("inc"), F.col("canon")
    key = lambda mark, *parts: F.concat(F.lit(mark), F.concat_ws(" ", *parts))
    last = lambda t: F.try_element_at(t, F.lit(-1))
    left = with_rarest(left, "name", "inc", token_holders(right, "canon"))
    right = with_rarest(right, "cnorm", "canon", token_holders(left.select("team", "inc"), "inc"))
    lkeys = F.array(
        F.when(F.col("norm") != "", key("n:", F.col("norm"))), F.when(F.size(inc) > 0, key("f:", last(inc), first_name(first))), F.when((F.size(inc) > 0) & (F.length(first) == 1), key("i:", last(inc), first)),
        F.when(F.col("rarest").isNotNull(), key("d:", F.col("rarest"))), *case_keys,
    )
    name = F.get(canon, 0)
    rkeys = F.array(
        F.when(F.col("cnorm") != "", key("n:", F.col("cnorm"))), F.when(F.size(canon) > 0, key("f:", last(canon), first_name(name))), F.when(F.size(canon) > 0, key("i:", last(canon), F.substring(name, 1, 1))),
        F.when(F.col("rarest").isNotNull(), key("e:", F.col("rarest"))), *roster_keys,
    )
    tokens = lambda mark, t: F.transform(F.array_distinct(t), lambda x: F.concat(F.lit(mark), x))
    tails = F.when(F.size(inc) >= 2, F.transform(F.sequence(F.lit(2), F.size(inc)), lambda k: key("t:", F.slice(inc, F.size(inc) - k + 1, k))))
    left = left.withColumn("lkeys", _keys(lkeys, tokens("e:", inc), tails)).drop("rarest")
    return _meeting(left, right.withColumn("rkeys", _keys(rkeys, tokens("d:", canon))).drop("rarest"))


def match_roster(cases: DataFrame, roster: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """case_id, player, confidence, rule for the matched. cases: team, case_id, raw; roster: team, ord, player, name.

    Each name of a team is matched once, however many cases have it. Names and roster rows meet by keys of the rules (see
    _indexed); how many rows have a last name is counted, not paired.
    A single token decides by unique last name or not at all. Else the first roster row with a strong rule (exact, same
    last and first name, compound last name) wins, else the best weak one (subsets), earlier rows first at ties."""
    names = cases.select("team", F.col("raw").alias("name")).distinct()
    found = _match_names(names, roster, min_confidence)
    return cases.select("team", "case_id", F.col("raw").alias("name")).join(found.hint("merge"), ["team", "name"]).select("team", "case_id", "player", "confidence", "rule")


def _match_names(names: DataFrame, roster: DataFrame, min_confidence: float) -> DataFrame:
    inc, tokens, canon = F.col("inc"), F.col("tok"), F.col("canon")
    left = names.select("team", "name", significant_tokens(F.col("name")).alias("inc"), all_tokens(F.col("name")).alias("tok"), normalize_name(F.col("name")).alias("norm"))
    # of players of one name the first by ord decides; the others only count
    rostered = roster.groupBy("team", F.col("name").alias("known")).agg(F.min(F.struct("ord", "player")).alias("_first"), F.count(F.lit(1)).alias("players"), F.min("player").alias("least"))
    right = rostered.select("team", "_first.*", "players", "least", significant_tokens(F.col("known")).alias("canon"), normalize_name(F.col("known")).alias("cnorm"))
    right = right.withColumn("size", last_name_length(F.col("canon")))  # once per name, not per pair
    n, m, a = F.size(inc), F.size(canon), F.size(tokens)
    last = lambda t: F.when(F.size(t) > 0, F.element_at(t, -1))
    first = lambda t: F.get(t, 0)
    lone = (n == 1) & (a == 1)
    singles = left.where(lone).select("team", "name", first(inc).alias("last"))
    by_last = right.select("team", "players", "least", last(canon).alias("last")).groupBy("team", "last").agg(F.sum("players").alias("hits"), F.min("least").alias("only"))
    counted = singles.join(by_last.hint("merge"), ["team", "last"]).select("team", "name", "hits", "only")
    compound = F.when((F.col("size") >= 2) & (F.col("size") < m), F.concat(F.lit("t:"), F.concat_ws(" ", F.slice(canon, m - F.col("size") + 1, F.col("size")))))
    undecided = left.join(counted.select("team", "name").hint("merge"), ["team", "name"], "left_anti")
    pairs = _indexed(undecided, right, first(tokens), [], [compound])
    size = F.col("size")
    tail = lambda t, k: F.slice(t, F.greatest(F.size(t) - k + 1, F.lit(1)), k)
    subset = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    ratio = F.when(m > 0, 0.7 + 0.2 * n / m)
    rule_d = subset(inc, canon) & ((a == 1) | same_first_name(first(tokens), first(canon)))
    rule_e = subset(canon, inc) & F.coalesce(F.array_contains(inc, last(canon)), F.lit(False)) & (m <= n)
    strong = (
        F.when((F.col("norm") == F.col("cnorm")) & (F.col("norm") != ""), F.struct(F.lit(0).alias("p"), F.lit(1.0).alias("c"), F.lit("exact").alias("r")))
        .when((a >= 2) & (m >= 2) & (last(inc) == last(canon)) & same_first_name(first(tokens), first(canon)) & F.lit(min_confidence <= 0.95), F.struct(F.lit(1).alias("p"), F.lit(0.95).alias("c"), F.lit(ALIAS).alias("r")))
        .when((size >= 2) & (size < m) & (n >= size) & (tail(inc, size) == tail(canon, size)) & F.lit(min_confidence <= 0.9), F.struct(F.lit(2).alias("p"), F.lit(0.9).alias("c"), F.lit(ALIAS).alias("r")))
    )
    weak = F.when(rule_d & (ratio >= min_confidence) & (~rule_e | (ratio >= 0.85)), F.struct(ratio.alias("c"), F.lit(SUBSET_INVERSE).alias("r"))).when(rule_e & F.lit(min_confidence <= 0.85), F.struct(F.lit(0.85).alias("c"), F.lit(SUBSET_CANON).alias("r")))
    pairs = pairs.select("team", "name", "ord", "player", strong.alias("strong"), weak.alias("weak")).where("strong is not null or weak is not null")
    by_strong = F.struct("player", F.col("strong.c").alias("confidence"), F.col("strong.r").alias("rule"))
    by_weak = F.struct("player", F.col("weak.c").alias("confidence"), F.col("weak.r").alias("rule"))
    best = pairs.groupBy("team", "name").agg(
        F.min_by(by_strong, F.when(F.col("strong").isNotNull(), F.struct("ord", "strong.p"))).alias("s"),
        F.min_by(by_weak, F.when(F.col("weak").isNotNull(), F.struct(-F.col("weak.c"), F.col("ord")))).alias("w"),
    )
    decided = best.select("team", "name", F.coalesce("s", "w").alias("f")).select("team", "name", "f.*")
    unique = counted.where((F.col("hits") == 1) & F.lit(min_confidence <= 0.85)).select("team", "name", F.col("only").alias("player"), F.lit(0.85).alias("confidence"), F.lit(UNIQUE).alias("rule"))
    return decided.unionByName(unique)


def near_misses(cases: DataFrame, roster: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """team, case_id, player, confidence, rule for every roster row that a name comes near to, within a band (inclusive).

    The first form that a pair has decides, even where it then gives nothing: equal, one token, the same last token, a
    subset. Names meet roster rows by keys of these forms (see _indexed); a pair without one comes near in no form."""
    names = cases.select("team", F.col("raw").alias("name")).distinct()
    rostered = roster.select("team", F.col("name").alias("known")).distinct()
    left = names.select("team", "name", normalize_name(F.col("name")).alias("norm"), significant_tokens(F.col("name")).alias("inc"))
    right = rostered.select("team", "known", normalize_name(F.col("known")).alias("cnorm"), significant_tokens(F.col("known")).alias("canon"))
    inc, canon, n, m = F.col("inc"), F.col("canon"), F.size("inc"), F.size("canon")
    single = F.when(n == 1, F.concat(F.lit("l:"), F.get(inc, 0)))
    pairs = _indexed(left, right, F.get(inc, 0), [single], [F.when(m >= 2, F.concat(F.lit("l:"), F.element_at(canon, -1)))])
    rule = lambda c, r: F.struct(c.alias("c"), F.lit(r).alias("r"))
    last = lambda t: F.try_element_at(t, F.lit(-1))
    alias = F.when(same_first_name(F.get(inc, 0), F.get(canon, 0)), rule(F.lit(0.95), ALIAS))
    lone = F.when(last(canon) == F.get(inc, 0), rule(F.lit(0.85), UNIQUE))
    subset = F.when(F.size(F.array_except(inc, canon)) == 0, rule(0.7 + 0.2 * n / m, SUBSET_INVERSE))
    found = (
        F.when(F.col("norm") == F.col("cnorm"), rule(F.lit(1.0), "exact"))
        .when((n == 1) & (m >= 2), lone)
        .when((n >= 2) & (m >= 2) & (last(inc) == last(canon)), alias)
        .when((n >= 1) & (m >= 1), subset)
    )
    rows = pairs.select("team", "name", "known", found.alias("f")).where("f is not null")
    near = rows.select("team", "name", "known", F.col("f.c").alias("confidence"), F.col("f.r").alias("rule")).where(F.col("confidence").between(low, high))
    # names near each other are dealt to all who have them; neither side is broadcast, its rows may be many times its files
    players = roster.select("team", F.col("name").alias("known"), "player")
    dealt = near.join(players.hint("merge"), ["team", "known"]).drop("known")
    asked = cases.select("team", "case_id", F.col("raw").alias("name"))
    return asked.join(dealt.hint("merge"), ["team", "name"]).select("team", "case_id", "player", "confidence", "rule")


def unique_references(asked: DataFrame, roster: DataFrame) -> DataFrame:
    """asked (team, short, name and more) with unique_reference: whether short, a single word, is the first or last token of
    name, and at most one name of the team's roster (team, name) has it.

    How many names have a token is counted once per team and token, so no row carries its team's list."""
    holders = token_holders(roster.select("team", significant_tokens(F.col("name")).alias("t")), "t")
    x, y = significant_tokens(F.col("short")), significant_tokens(F.col("name"))
    rows = asked.withColumn("_word", F.when(F.size(x) == 1, F.get(x, 0)))
    rows = rows.join(holders.select("team", F.col("token").alias("_word"), "holders"), ["team", "_word"], "left")
    fits = (F.size(y) >= 2) & ((F.col("_word") == F.get(y, 0)) | (F.col("_word") == F.try_element_at(y, F.lit(-1))))
    alone = F.coalesce("holders", F.lit(0)) <= 1
    return rows.withColumn("unique_reference", F.coalesce(F.col("_word").isNotNull() & fits & alone, F.lit(False))).select(*asked.columns, "unique_reference")


def same_player(a: Column, b: Column) -> Column:
    """Whether two names mean one player: the same last name with first names alike, a lone first name, equality, or a
    subset of at least two tokens. False where either is null or blank."""
    x, y, na, nb = significant_tokens(a), significant_tokens(b), normalize_name(a), normalize_name(b)
    lone, longer = F.when(F.size(x) == 1, F.get(x, 0)).when(F.size(y) == 1, F.get(y, 0)), F.when(F.size(x) == 1, y).otherwise(x)
    both = (F.size(x) >= 2) & (F.size(y) >= 2)
    last = F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))
    full = lambda c: first_name(c, FEWER_NICKNAMES)
    first = full(F.get(F.split(na, " "), 0)) == full(F.get(F.split(nb, " "), 0))
    single = (F.size(longer) >= 2) & (full(lone) == full(F.get(longer, 0)))
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce((na != "") & (nb != "") & ((na == nb) | (both & ((last & first) | subset)) | (~both & single)), F.lit(False))


def unmatched(cases: DataFrame, matched: DataFrame) -> DataFrame:
    """Dead letters: cases without a match, names as they came."""
    return cases.join(matched.select("team", "case_id").hint("merge"), ["team", "case_id"], "left_anti")


def duplicate_pairs(players: DataFrame, key: Column) -> DataFrame:
    """a, b (by ord) of one team whose key is equal: an equality join, not all pairs of a team."""
    one = players.withColumn("k", key).where("k is not null")
    a, b = one.select("team", "k", F.col("ord").alias("a")), one.select("team", "k", F.col("ord").alias("b"))
    return a.join(b, ["team", "k"]).where("a < b").select("team", "a", "b")


def duplicate_links(players: DataFrame, key: Column) -> DataFrame:
    """a, b: every row whose key another of its team has, linked to the first with it: as few links as rows, for clusters."""
    first = F.min("ord").over(Window.partitionBy("team", "k"))
    return players.withColumn("k", key).where("k is not null").select("team", first.alias("a"), F.col("ord").alias("b")).where("a < b")


def clusters(pairs: DataFrame) -> DataFrame:
    """node, leader (the smallest reachable) of links a, b: the minimum over neighbours, then the leader's leader, until
    nothing changes, however many rounds that takes. Each round is written once, so its lineage ends there."""
    edges = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(edges)
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).select(F.col("a").alias("node"), F.col("l").alias("leader")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("leader").alias("m"))
        hop = labels.select(F.col("node").alias("leader"), F.col("leader").alias("up"))
        new = labels.join(hop, "leader").join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("leader", "up", "m").alias("new"), "leader")
        new = written(new)
        done = new.where("new < leader").isEmpty()
        labels = new.select("node", F.col("new").alias("leader"))
        if done:
            return labels
