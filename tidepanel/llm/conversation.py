"""Conversation structure repair by iterative-deepening A*.

A conversation's rows are edited until their role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete
2, Insert of an empty user or assistant turn 5; a truncated row that stays adds 5; blank and repeated rows must go. The search
goes depth first, edits in the order of their letters (D, I, K, R), up to a bound on cost so far plus a lower bound of what is to come; the
bound rises to the least value that exceeded it. A table remembers, per (row, place in the pattern), the cost that a failed
search has proved to be needed, so no state is searched twice with no more money. The first path accepted is the
cheapest and of those the first in letter order.

A conversation of at most ``RUN`` rows is searched whole, in a task that meets the rows dealt out by range of (conversation,
turn). Longer ones, and those at the border of two ranges, are cut into runs of at most ``RUN`` rows. Each run is searched
for every pair of places in the pattern where it may be entered and left. Tables of (cost, order of letters) of neighbouring runs combine by
the least sum over the place between them, 1024 runs into a chunk, chunks into the conversation; the best places go back down to
the runs, whose edits are then known. Orders of letters combine as well, because a cheapest path never inserts (an insertion and
the turn next to it could both go for less), so the paths compared have one letter a row. No task holds a conversation: repeated
rows are found by an aggregate, and the checksum of the repaired text is a stream over sorted rows.

Defined results: a null conversation id is a conversation; null turns come first; a null role or text counts as one space; rows
of one turn are ordered by role, then text; a role with another initial is reroled or deleted; repeated rows are faults like
any repetition; a conversation without rows costs nothing; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import read
from tidepanel.scale import freeze

RUN = 32
CHUNK = 1024
# Fixed costs of the edits
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
# faults of a row, and a place holder that only says that the conversation is there
SOUND, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
# places in the pattern: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
INITIAL = "\0sua"
ROLE = ("", "", "user", "assistant")
ACCEPTED = (START, ASSISTANT)
NEVER = 1 << 40


class Search:
    """Cheapest edits of a run of rows (initial, fault), for one set of places where the pattern may be left."""

    def __init__(self, rows: list[tuple[str, int]], goals: tuple[int, ...]):
        self.rows, self.goals = rows, goals
        n = len(rows)
        self.least = [0] * (n + 1)  # lower bound of the cost from a row on
        pairs, systems = [0] * (n + 2), 0
        fixed = 0
        for i in range(n - 1, -1, -1):
            initial, fault = rows[i]
            own = 2 if fault != SOUND else 0 if initial in ("u", "a") else 0 if initial == "s" else 1
            systems += fault == SOUND and initial == "s"
            fixed += own
            # two equal neighbours cannot both stay as they are
            same = i + 1 < n and fault == SOUND == rows[i + 1][1] and initial == rows[i + 1][0] and initial in ("u", "a")
            pairs[i] = max(pairs[i + 1], 1 + pairs[i + 2] if same else 0)
            self.least[i] = fixed + pairs[i] + max(0, systems - 1)
        self.needed: dict[tuple[int, int], int] = {}

    def moves(self, i: int, place: int):
        """(letter, cost, row, place) in letter order."""
        out = []
        if i < len(self.rows):
            out.append(("D", DELETE, i + 1, place))
        out.append(("I", INSERT, i, NEXT[place]))
        if i < len(self.rows):
            initial, fault = self.rows[i]
            if fault in (SOUND, TRUNCATED):
                more = UNFINISHED if fault == TRUNCATED else 0
                if initial == "s" and place == START:
                    out.append(("K", more, i + 1, SYSTEM))
                elif initial == INITIAL[NEXT[place]]:
                    out.append(("K", more, i + 1, NEXT[place]))
                out.append(("R", REROLE + more, i + 1, NEXT[place]))
        return out

    def within(self, place: int, bound: int) -> tuple[int, str | None]:
        """The first accepted path of at most ``bound``, or the least cost that is needed instead."""
        n, path = len(self.rows), []
        stack = [[0, place, bound, iter(self.moves(0, place)), NEVER]]
        if n == 0 and place in self.goals:
            return 0, ""
        while stack:
            top = stack[-1]
            move = next(top[3], None)
            if move is None:
                i, at, _, _, lowest = stack.pop()
                self.needed[i, at] = max(lowest, self.needed.get((i, at), 0))
                if not stack:
                    return lowest, None
                letter_cost = path.pop()[1]
                stack[-1][4] = min(stack[-1][4], letter_cost + self.needed[i, at])
                continue
            letter, cost, i, at = move
            money = top[2] - cost
            need = max(self.needed.get((i, at), 0), self.least[i])
            if need > money:
                top[4] = min(top[4], cost + need)
                continue
            if i == n and at in self.goals:
                return bound - money, "".join(p[0] for p in path) + letter
            path.append((letter, cost))
            stack.append([i, at, money, iter(self.moves(i, at)), NEVER])
        return NEVER, None

    def best(self, place: int) -> tuple[int, str]:
        """Cost and letters of the cheapest path from ``place``; NEVER if the pattern cannot be left there."""
        keepable = any(r[0] == "s" and r[1] in (SOUND, TRUNCATED) for r in self.rows)
        reachable = {START: {START, USER, ASSISTANT} | ({SYSTEM} if keepable else set()), SYSTEM: {SYSTEM, USER, ASSISTANT}}
        if not reachable.get(place, {USER, ASSISTANT}) & set(self.goals):
            return NEVER, ""
        bound = max(self.needed.get((0, place), 0), self.least[0])
        while True:
            cost, letters = self.within(place, bound)
            if letters is not None:
                return cost, letters
            bound = cost


def places_after(place: int, rows: list[tuple[str, int]], letters: str) -> list[int]:
    """The place after each edit."""
    out, i = [], 0
    for letter in letters:
        if letter == "K" and rows[i][0] == "s" and place == START:
            place = SYSTEM
        elif letter != "D":
            place = NEXT[place]
        i += letter != "I"
        out.append(place)
    return out


def repaired_lines(place: int, rows: list[tuple[str, int]], said: list[tuple[str, str]], letters: str) -> list[tuple[str, str]]:
    """(role, text) of what is left after the edits."""
    out, i = [], 0
    for letter, at in zip(letters, places_after(place, rows, letters)):
        if letter == "K":
            out.append(said[i])
        elif letter == "R":
            out.append((ROLE[at], said[i][1]))
        elif letter == "I":
            out.append((ROLE[at], ""))
        i += letter != "I"
    return out


def _table(rows: list[tuple[str, int]]) -> tuple[list[int], list[int], list[str]]:
    """For every (entered, left): cost, place in the order of letters among those entered alike, letters."""
    found = [[("", NEVER)] * 4 for _ in range(4)]
    for left in range(4):
        search = Search(rows, (left,))
        for entered in range(4):
            cost, letters = search.best(entered)
            found[entered][left] = (letters, cost)
    costs = [found[a][b][1] for a in range(4) for b in range(4)]
    order = []
    for a in range(4):
        ranked = sorted(x[0] for x in found[a])
        order += [ranked.index(x[0]) for x in found[a]]
    return costs, order, [found[a][b][0] for a in range(4) for b in range(4)]


def _joined(first: tuple[list[int], list[int]], second: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """Tables of (cost, order) of two neighbouring stretches as one."""
    cost, key = [NEVER] * 16, [(9, 9)] * 16
    for a in range(4):
        for b in range(4):
            for m in range(4):
                c = min(NEVER, first[0][4 * a + m] + second[0][4 * m + b])
                k = (first[1][4 * a + m], second[1][4 * m + b])
                if c < NEVER and (c, k) < (cost[4 * a + b], key[4 * a + b]):
                    cost[4 * a + b], key[4 * a + b] = c, k
    order = []
    for a in range(4):
        ranked = sorted(key[4 * a : 4 * a + 4])
        order += [ranked.index(k) for k in key[4 * a : 4 * a + 4]]
    return cost, order


def _route(tables: list[tuple[list[int], list[int]]], entered: int, goals: tuple[int, ...]) -> tuple[int, list[int]]:
    """Cost of the best way through all stretches and the place after each."""
    togo = [0 if p in goals else NEVER for p in range(4)]
    rest = [togo]
    for cost, _ in reversed(tables):
        togo = [min(min(NEVER, cost[4 * a + b] + togo[b]) for b in range(4)) for a in range(4)]
        rest.append(togo)
    rest.reverse()
    total, places = rest[0][entered], []
    for (cost, order), after, here in zip(tables, rest[1:], rest):
        choices = [b for b in range(4) if cost[4 * entered + b] + after[b] == here[entered]]
        entered = min(choices, key=lambda b: order[4 * entered + b])
        places.append(entered)
    return total, places


CONVERSATION = "n bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = ("su", "ua", "au")


class Digest:
    """SHA-256 of lines joined by line breaks."""

    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False


def _whole(rows: list[dict]) -> tuple:
    """CONVERSATION of the rows of one, in order."""
    rows = [r for r in rows if r["fault"] != ABSENT]
    seen, edited = set(), []
    for r in rows:
        said = (r["role"], r["text"])
        edited.append((r["role"][:1], DUPLICATE if r["fault"] != BLANK and said in seen else r["fault"]))
        seen.add(said)
    cost, letters = Search(edited, ACCEPTED).best(START)
    digest = Digest()
    for line in repaired_lines(START, edited, [(r["role"], r["text"]) for r in rows], letters):
        digest.add(*line)
    turns = {r["turn"] for r in rows} - {None}
    faults = [e[1] for e in edited]
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(edited, edited[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return len(rows), gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, letters, digest.hash.hexdigest()


def _searched(names: list[str]):
    """Whole short conversations of a range as results; the rows of others pass with their place ``at``."""

    def run(batches):
        import pyarrow as pa

        number = [(TaskContext.get().partitionId() + 1) << 40]
        held: list[dict] = []
        key, first, long = None, True, False

        def rest(rows, batch):
            for r in rows:
                batch.append({**r, "at": number[0]})
                number[0] += 1

        def close(out, last=False):
            """End of a conversation; the next one starts a new run and a new chunk."""
            if long or first or last:
                rest(held, out)
                number[0] += -number[0] % (RUN * CHUNK)
            elif held:
                values = _whole(held)
                out.append({"conv": held[0]["conv"], **dict(zip([c.split()[0] for c in CONVERSATION.split(", ")], values))})
            held.clear()

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                own = (r["conv"],)
                if key is not None and own != key:
                    close(out)
                    first, long = False, False
                key = own
                held.append(r)
                if len(held) > RUN:
                    long = True
                if long:
                    rest(held, out)
                    held.clear()
            yield pa.RecordBatch.from_pylist(out, schema)
        out = []
        if key is not None:
            close(out, last=True)
        yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(", ".join(names)))
    return run


SPACE = " \t\n\x0b\x0c\r"


def faults_of(text: Column) -> Column:
    """BLANK, TRUNCATED or SOUND; repetitions are found later."""
    said = F.rtrim(text, F.lit(SPACE))
    return F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None):
    """(conversations, edits): counts, cost, audit and checksum per conversation; and the edits of rows of long ones.

    Rows for which ``absent`` holds only say that their conversation exists.
    """
    absent = F.coalesce(absent, F.lit(False)) if absent is not None else F.lit(False)
    spoken = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    base = rows.select(
        F.col(f"`{conv_col}`").alias("conv"),
        F.when(~absent, F.col(f"`{turn_col}`").cast("bigint")).alias("turn"),
        spoken[0].alias("role"),
        F.when(absent, "").otherwise(spoken[1]).alias("text"),
        F.when(absent, ABSENT).otherwise(faults_of(spoken[1])).alias("fault"),
        F.monotonically_increasing_id().alias("row"),  # parts equal rows, so that ranges can
    )
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row"]
    dealt = base.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    kind = rows.schema[conv_col].dataType.simpleString()
    names = [f"conv {kind}", "turn bigint", "role string", "text string", "fault int", "at bigint", *CONVERSATION.split(", ")]
    met = freeze(dealt.mapInArrow(_searched(names), ", ".join(names)), "conversations")
    whole = met.filter(F.col("at").isNull()).select("conv", *[c.split()[0] for c in CONVERSATION.split(", ")])
    parted, edits = _in_runs(met.filter(F.col("at").isNotNull()).select("conv", "turn", "role", "text", "fault", "at"), kind)
    return whole.unionByName(parted), edits


def _in_runs(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The same for conversations cut into runs; ``at`` numbers the rows, every run and chunk has one conversation."""
    present = rows.filter(F.col("fault") != ABSENT)
    first = present.groupBy("conv", "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    slim = present.select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), "fault").join(first, "at", "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNull(), DUPLICATE).otherwise(F.col("fault"))
    slim = slim.withColumn("fault", fault).withColumn("run", F.floor(F.col("at") / RUN))
    row = F.struct("at", "turn", "initial", "fault")
    runs = slim.groupBy("conv", "run").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # at most RUN rows
    runs = freeze(_with_tables(runs), "runs")

    def joined(tables: DataFrame, by: list[str], part: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), "counts", "table")))
        return _combined(tables.groupBy(*by).agg(parts.alias("parts")))

    chunks = runs.withColumn("chunk", F.floor(F.col("run") / CHUNK))
    chunks = freeze(joined(chunks, ["conv", "chunk"], "run"), "chunks")
    total = freeze(_routed(joined(chunks, ["conv"], "chunk"), START, True), "routes")

    # the places where each chunk, then each run, is entered and left
    way = total.select(F.explode(F.arrays_zip("names", "entered", "left")).alias("x")).select(F.col("x.names").alias("chunk"), "x.entered", "x.left")
    inner = chunks.select("chunk", "parts", "table").join(way, "chunk")
    inner = _routed(inner, None, False).select(F.explode(F.arrays_zip("names", "entered", "left")).alias("x"))
    inner = inner.select(F.col("x.names").alias("run"), "x.entered", "x.left")
    taken = runs.join(inner, "run")
    taken = taken.withColumn("letters", F.element_at("letters", F.col("entered") * 4 + F.col("left") + 1)).select("conv", "run", "rows", "entered", "letters")
    taken = freeze(taken, "edits")
    edits = _row_edits(taken)
    audit = taken.groupBy(F.col("conv")).agg(F.array_sort(F.collect_list(F.struct("run", "letters"))).alias("a"))
    audit = audit.select(F.col("conv").alias("c"), F.array_join(F.transform("a", lambda x: x["letters"]), "").alias("audit"))

    said = present.select("at", "role", "text").join(edits, "at")
    lines = said.select("conv", "at", "edit", F.when(F.col("edit") == "R", F.col("to")).otherwise(F.col("role")).alias("role"), "text")
    lines = lines.filter(F.col("edit") != "D").repartition("conv").sortWithinPartitions("conv", "at")
    digests = lines.select("conv", "role", "text").mapInArrow(_digests(kind), f"c {kind}, repaired_sha256 string")

    counts = total.select("conv", *[F.col("counts")[c].alias(c) for c in ("n", "gaps", "blank", "duplicate", "truncated", "illegal")], "cost")
    named = rows.select("conv").distinct().withColumnRenamed("conv", "name")
    out = named.join(counts, F.col("name").eqNullSafe(F.col("conv")), "left").drop("conv")
    out = out.join(audit, F.col("name").eqNullSafe(F.col("c")), "left").drop("c")
    out = out.join(digests, F.col("name").eqNullSafe(F.col("c")), "left").drop("c")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    filled = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", *COUNTS)]
    texts = [F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in empty.items()]
    return out.select(F.col("name").alias("conv"), *filled, *texts), edits


# what runs know of their rows; firsts and lasts meet those of the neighbours
STATE = (
    "counts struct<n:bigint,gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,turns:bigint,"
    "first_turn:bigint,last_turn:bigint,first:string,last:string>, table struct<cost:array<bigint>,rank:array<int>>"
)


def _arrow(function, schema: str, *columns: Column) -> Column:
    """An Arrow function of rows given as Python values, a tuple of fields a row."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(schema))

    def over(one: pa.Array) -> pa.Array:
        names = [f.name for f in kind]
        return pa.array([dict(zip(names, function(*r.as_py().values()))) for r in one], kind)

    over.__annotations__ = {"one": pa.Array, "return": pa.Array}
    return F.arrow_udf(over, schema)(F.struct(*columns))


def _with_tables(runs: DataFrame) -> DataFrame:
    """Counts, table and letters of each run."""

    def searched(rows):
        pairs = [(r["initial"], r["fault"]) for r in rows]
        turns = sorted({r["turn"] for r in rows} - {None})
        faults = [p[1] for p in pairs]
        illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(pairs, pairs[1:]))
        ends = (turns[0], turns[-1]) if turns else (None, None)
        known = [len(rows), 0, *[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)], illegal, len(turns), *ends, pairs[0][0], pairs[-1][0]]
        cost, rank, letters = _table(pairs)
        names = ("n", "gaps", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first", "last")
        return dict(zip(names, known)), {"cost": cost, "rank": rank}, letters

    found = _arrow(searched, f"{STATE}, letters array<string>", F.col("rows"))
    return runs.withColumn("_f", found).select("conv", "run", "rows", "_f.counts", "_f.table", "_f.letters")


def _combined(groups: DataFrame) -> DataFrame:
    """Counts and table of neighbouring ``parts`` as of one stretch."""

    def together(parts):
        counts, table = None, None
        for p in parts:
            c, t = p["counts"], (p["table"]["cost"], p["table"]["rank"])
            if counts is None:
                counts, table = dict(c), t
                continue
            table = _joined(table, t)
            border = counts["last"] + c["first"] not in LEGAL
            shared = counts["last_turn"] is not None and counts["last_turn"] == c["first_turn"]
            for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns"):
                counts[k] += c[k]
            counts["illegal"] += border
            counts["turns"] -= shared
            counts["last"] = c["last"]
            if counts["first_turn"] is None:
                counts["first_turn"] = c["first_turn"]
            if c["last_turn"] is not None:
                counts["last_turn"] = c["last_turn"]
        if counts["first_turn"] is not None:
            counts["gaps"] = counts["last_turn"] - counts["first_turn"] + 1 - counts["turns"]
        return counts, {"cost": table[0], "rank": table[1]}

    keys = [c for c in groups.columns if c != "parts"]
    return groups.withColumn("_f", _arrow(together, STATE, F.col("parts"))).select(*keys, "parts", "_f.counts", "_f.table")


def _routed(groups: DataFrame, entered: int | None, accept: bool) -> DataFrame:
    """The best way through the parts of each group: where each part is entered and left."""

    def way(parts, start, left):
        tables = [(p["table"]["cost"], p["table"]["rank"]) for p in parts]
        cost, places = _route(tables, start, ACCEPTED if accept else (left,))
        return cost, [p["part"] for p in parts], [start, *places[:-1]], places

    start = F.lit(entered) if entered is not None else F.col("entered")
    left = F.lit(0) if accept else F.col("left")
    schema = "cost bigint, names array<bigint>, entered array<int>, left array<int>"
    keys = [c for c in groups.columns if c not in ("parts", "entered", "left", "table")]
    found = groups.withColumn("_f", _arrow(way, schema, F.col("parts"), start.alias("start"), left.alias("goal")))
    return found.select(*keys, "_f.cost", "_f.names", "_f.entered", "_f.left")


def _row_edits(taken: DataFrame) -> DataFrame:
    """One row per edited row: at, conv, edit and the role it gets. A cheapest path has no insertions."""

    def each(rows, entered, letters):
        pairs = [(r["initial"], r["fault"]) for r in rows]
        places = places_after(entered, pairs, letters)
        return ([{"at": r["at"], "edit": e, "to": ROLE[p]} for r, e, p in zip(rows, letters, places)],)

    found = _arrow(each, "e array<struct<at:bigint,edit:string,to:string>>", F.col("rows"), F.col("entered"), F.col("letters"))
    return taken.withColumn("_f", found).select("conv", F.explode("_f.e").alias("e")).select("conv", "e.at", "e.edit", "e.to")


def _digests(kind: str):
    """Checksum per conversation of sorted lines, as they stream by."""

    def run(batches):
        import pyarrow as pa

        key, digest, names, sums = None, None, [], []
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv != key:
                    if digest is not None:
                        names.append(key)
                        sums.append(digest.hash.hexdigest())
                    key, digest = conv, Digest()
                digest.add(role, text)
        if digest is not None:
            names.append(key)
            sums.append(digest.hash.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(names, schema.field(0).type), pa.array(sums, pa.string())], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"c {kind}, repaired_sha256 string"))
    return run


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage of the query: by a checksum of the key rows are dropped (column ``gone``), emptied, shortened, repeated or reroled."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    case = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), text.alias("text"), (case == 0).alias("gone"), copies)


def repair_conversations(spark, sf: str) -> DataFrame:
    """The thin query: repair of the damaged table."""
    rows = damaged(read(spark, sf, "conversations"))
    found, _ = repair(rows, absent=F.col("gone"))
    return found.select(F.col("conv").alias("conv_id"), *COUNTS, "audit", "repaired_sha256")
