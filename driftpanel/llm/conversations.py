"""Conversation repair: cheapest edits by dynamic programming, the least audit by prefix doubling over optimal arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: White space that a text may consist of and still be blank.
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, KEEP, REROLE = 68, 73, 75, 82  # the initials of the edits
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
FAR = 1 << 40
#: States of the wanted roles ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
#: Where the next user or assistant turn leads, and which role it has.
ONWARD = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
#: Rows of one conversation that are ranked together, and path places that are read together.
SEGMENT = 1 << 15
PLACES = 1 << 21
#: Rows whose conversations are settled together.
BLOCK_ROWS = 50_000
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage, and ``copies``, how often the row is there (0: dropped).

    Nulls of role and text count as one space; the draw is crc32 of ``conv_id:turn`` modulo 20.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kept = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        blank("role").alias("role"),
        blank("text").alias("text"),
        (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20).alias("draw"),
    )
    draw = F.col("draw")
    return kept.select(
        "conv_id",
        "turn",
        F.when(draw == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, F.lit("")).when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )


def _steps(fault, initial):
    """Cost of keeping and of reroling each row, and where keeping leads from each state (-1: not allowed)."""
    import numpy as np

    n = len(fault)
    extra = np.where(fault == 3, TRUNCATED_COST, 0).astype(np.int64)
    usable = (fault == 0) | (fault == 3)
    to = np.full((n, 4), -1, np.int8)
    s, u, a = (usable & (initial == ord(c)) for c in "sua")
    to[s, 0] = 1
    for state in (0, 1, 3):
        to[u, state] = 2
    to[a, 2] = 3
    return extra, usable, to


def cheapest(fault, initial, start, length, end=None):
    """Least cost from every (place, state) to the end, and the letters and targets of the optimal arcs.

    Conversations lie one behind the other: ``start`` and ``length`` give their rows. Conversation c has
    the places ``start[c] + c`` to ``start[c] + c + length[c]``. ``end`` are the costs at the last place where
    more rows follow. Arcs are an array (place, state, edit) of targets, -1 where an edit is not optimal,
    edits in order of their initials.
    """
    import numpy as np

    c = len(start)
    extra, usable, to = _steps(fault, initial)
    h = np.full((int(length.sum()) + c, 4), FAR, np.int64)
    arcs = np.full((len(h), 4, 4), -1, np.int64)
    last = start + np.arange(c) + length
    order = np.argsort(-length, kind="stable")
    sorted_length = length[order]
    onward = np.array(ONWARD)
    for back in range(int(sorted_length[0]) + 1 if c else 0):
        some = order[: int(np.searchsorted(-sorted_length, -back, side="right"))]
        place = last[some] - back
        cost = np.full((len(some), 4, 4), FAR, np.int64)  # state, edit
        if back:
            row = place - some
            after = h[place + 1]
            cost[:, :, 0] = DELETE_COST + after
            keep = to[row]
            cost[:, :, 2] = np.where(keep >= 0, extra[row, None] + np.take_along_axis(after, np.maximum(keep, 0), 1), FAR)
            cost[:, :, 3] = np.where(usable[row, None], REROLE_COST + extra[row, None] + after[:, onward], FAR)
            best = cost.min(2)
        elif end is None:
            best = np.tile(np.array([0, FAR, FAR, 0], np.int64), (len(some), 1))
        else:
            h[place] = end
            continue
        # an insertion leads to another state of the same place; two in a row come back to where they began
        for state in (2, 3, 2, 0, 1):
            best[:, state] = np.minimum(best[:, state], INSERT_COST + best[:, ONWARD[state]])
        cost[:, :, 1] = INSERT_COST + best[:, onward]
        h[place] = best
        optimal = (cost == best[:, :, None]) & (best[:, :, None] < FAR)
        here = place[:, None] * 4
        arcs[place, :, 1] = np.where(optimal[:, :, 1], here + onward, -1)
        if back:
            arcs[place, :, 0] = np.where(optimal[:, :, 0], here + 4 + np.arange(4), -1)
            arcs[place, :, 2] = np.where(optimal[:, :, 2], here + 4 + keep, -1)
            arcs[place, :, 3] = np.where(optimal[:, :, 3], here + 4 + onward, -1)
    return h, arcs


def ranked_paths(arcs, roots, most: int):
    """Letters of the least path from each root, and the node where each path ends.

    Nodes are ranked by the least strings of 1, 2, 4, ... letters that begin at them: a rank and a
    pointer to the node behind those letters double together. A letter leads from a node to one
    node only, so the least string has one end. Nodes without arcs end a path and come before all
    letters. Every node then takes the arc whose letter and whose target's rank are least, and
    the paths are read by expanding roots through the pointers of falling powers of two. ``most``
    bounds the letters of a path.
    """
    import numpy as np

    letters = np.array([DELETE, INSERT, KEEP, REROLE])
    flat = arcs.reshape(-1, 4)
    nodes = np.arange(len(flat))
    allowed = flat >= 0
    ends = ~allowed.any(1)
    first = np.argmax(allowed, 1)
    rank = np.where(ends, 0, letters[first])
    pointer = np.where(ends, nodes, flat[nodes, first])
    pointers = []
    reach = 1
    while reach < most:
        pointers.append(pointer)
        _, rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
        reach *= 2
    # of the optimal arcs the one with the least (letter, rank of the target)
    key = np.where(allowed, letters * (rank.max(initial=0) + 1) + rank[flat], np.iinfo(np.int64).max)
    letter = np.where(ends, 0, letters[np.argmin(key, 1)])
    paths = roots[:, None]
    for jump in reversed(pointers):
        paths = np.stack([paths, jump[paths]], axis=2).reshape(len(roots), -1)
    return letter[paths], paths


def repairs(fault, initial, start, length):
    """For each conversation its cost, audit, and for each edit the state in which it is made.

    ``fault`` of a row is 0, 1 (blank), 2 (duplicate), 3 (truncated), ``initial`` the code of its role's first letter.
    """
    import numpy as np

    out = [None] * len(start)
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        # about equally long conversations together, so that paths fit into one array
        c = order[at]
        if length[c] > SEGMENT:
            rows = slice(start[c], start[c] + length[c])
            out[c] = _long_repair(fault[rows], initial[rows])
            at += 1
            continue
        end = at + 1
        while end < len(order) and length[order[end]] <= SEGMENT and _width(length[order[end]]) * (end - at + 1) <= PLACES:
            end += 1
        some = order[at:end]
        at = end
        n = length[some]
        begin = np.cumsum(n) - n
        rows = np.repeat(start[some] - begin, n) + np.arange(int(n.sum()))
        h, arcs = cheapest(fault[rows], initial[rows], begin, n)
        roots = (begin + np.arange(len(some))) * 4
        letters, paths = ranked_paths(arcs, roots, _width(n[-1]))
        states = paths % 4
        sizes = (letters > 0).sum(1)
        for k, c in enumerate(some):
            out[c] = int(h.reshape(-1)[roots[k]]), letters[k, : sizes[k]].astype(np.uint8).tobytes(), states[k, : sizes[k]].astype(np.uint8)
    return out


def _width(n: int) -> int:
    """A power of two above the letters of any cheapest audit of ``n`` rows: deleting all costs 2 a row, an insertion 5."""
    return 1 << (2 * int(n) + 8).bit_length()


def _long_repair(fault, initial):
    """As ``repairs`` for one long conversation, segment by segment: first costs from the end, then paths from the start."""
    import numpy as np

    cuts = list(range(0, len(fault), SEGMENT))
    ends = [None] * len(cuts)
    zero = np.zeros(1, np.int64)
    for k in range(len(cuts) - 1, 0, -1):
        part = slice(cuts[k], cuts[k] + SEGMENT)
        h, _ = cheapest(fault[part], initial[part], zero, np.array([len(fault[part])]), ends[k])
        ends[k - 1] = h[0]
    state, cost, audit, states = 0, None, [], []
    for k, cut in enumerate(cuts):
        part = slice(cut, cut + SEGMENT)
        n = len(fault[part])
        h, arcs = cheapest(fault[part], initial[part], zero, np.array([n]), ends[k])
        letters, paths = ranked_paths(arcs, np.array([state]), _width(n))
        cost = int(h[0, 0]) if cost is None else cost
        size = int((letters[0] > 0).sum())
        audit.append(letters[0, :size].astype(np.uint8).tobytes())
        states.append((paths[0, :size] % 4).astype(np.uint8))
        state = int(paths[0, -1] % 4)
    return cost, b"".join(audit), np.concatenate(states)


def settled(conv, turn, without_turn, initial, fault, digest, n_conv: int):
    """Counts, cost, audit and states of each of ``n_conv`` conversations from the codes of their rows in order.

    ``conv`` numbers the conversations; a row of fault -1 was dropped and only says that its
    conversation exists. ``digest`` (two numbers a row) stands for role and text.
    """
    import numpy as np

    there = fault >= 0
    conv, turn, without_turn, initial, fault, digest = (x[there] for x in (conv, turn, without_turn, initial, fault, digest))
    length = np.bincount(conv, minlength=n_conv)
    start = np.cumsum(length) - length
    pair = conv[1:] == conv[:-1]
    # stable order by key: of rows with the same role and text all but the first were seen earlier
    order = np.lexsort((digest[:, 1], digest[:, 0], conv))
    again = (conv[order][1:] == conv[order][:-1]) & (digest[order][1:] == digest[order][:-1]).all(1)
    seen = np.zeros(len(conv), bool)
    seen[order[1:][again]] = True
    code = np.where(fault == 1, 1, np.where(seen, 2, np.where(fault == 2, 3, 0)))
    legal = np.zeros(len(pair), bool)
    for x, y in ("su", "ua", "au"):
        legal |= (initial[:-1] == ord(x)) & (initial[1:] == ord(y))
    # turns ascend within a conversation, rows without one come first
    c, t = conv[~without_turn], turn[~without_turn]
    new = np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])][: len(c)]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]][: len(c)])
    gaps = np.zeros(n_conv, np.int64)
    last = np.r_[first[1:], len(c)][: len(first)].astype(np.int64) - 1
    gaps[c[first]] = t[last] - t[first] + 1 - np.bincount(c[new], minlength=n_conv)[c[first]]
    counts = [gaps, *(np.bincount(conv[code == k], minlength=n_conv) for k in (1, 2, 3)), np.bincount(conv[1:][pair & ~legal], minlength=n_conv)]
    numbers = np.stack(counts, axis=1).tolist()
    return [(*numbers[k], *path) for k, path in enumerate(repairs(code, initial, start, length))]


class _Repair:
    """Applies the edits of one conversation to its rows as they pass; nothing but the hash is kept."""

    def __init__(self, audit: bytes, states):
        import hashlib

        self.audit, self.states, self.at, self.hash, self.mark = audit, states, 0, hashlib.sha256(), ""

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{self.mark}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.mark = "\n"

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self._put(ROLES[self.states[self.at]], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insertions()
        letter = self.audit[self.at]
        if letter != DELETE:
            self._put(ROLES[self.states[self.at]] if letter == REROLE else role, text)
        self.at += 1

    def digest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def _repaired(batches):
    """Rows in order of block, phase, conversation and turn to one row per conversation.

    A block's rows come twice: first as codes, from which all its conversations are settled together,
    then with their texts, which pass one by one.
    """
    import numpy as np
    import pyarrow as pa

    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def table(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def of_block(numbers, codes):
        results = settled(*(np.concatenate(c) for c in zip(*codes, strict=True)), len(numbers))
        return {i: (r[:6], _Repair(*r[6:])) for i, r in zip(numbers, results, strict=True)}

    def closed(repairs_of):
        return table([(i, *counts, r.audit.decode("ascii"), r.digest()) for i, (counts, r) in repairs_of.items()])

    numbers, codes, open_repairs, now = {}, [], None, None
    for batch in batches:
        block, phase = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (phase[1:] != phase[:-1])][: len(block)]).tolist()
        for begin, end in zip(edges, [*edges[1:], len(block)], strict=True):
            part, key = batch.slice(begin, end - begin), int(block[begin])
            ids = part.column(2).to_pylist()
            if key != now:
                if now is not None:
                    yield closed(open_repairs if open_repairs is not None else of_block(numbers, codes))
                numbers, codes, open_repairs, now = {}, [], None, key
            if phase[begin] == 0:
                conv = np.fromiter((numbers.setdefault(i, len(numbers)) for i in ids), np.int64, len(ids))
                turn = part.column(3)
                without = turn.is_null().to_numpy(zero_copy_only=False)
                digest = np.frombuffer(b"".join(part.column(6).to_pylist()), np.int64).reshape(-1, 2)
                codes.append((conv, turn.fill_null(0).to_numpy(), without, part.column(4).to_numpy(), part.column(5).to_numpy(), digest))
                continue
            if open_repairs is None:
                open_repairs, codes = of_block(numbers, codes), []
            for i, role, text in zip(ids, part.column(7).to_pylist(), part.column(8).to_pylist(), strict=True):
                open_repairs[i][1].row(role, text)
    if now is not None:
        yield closed(open_repairs if open_repairs is not None else of_block(numbers, codes))


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text``, damaged here first; other columns are ignored).

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    Rows go by turn, nulls first; rows that share a turn by role, then by the md5 of role and text. Nulls of role and text are one space (so the text is blank and the role fits nowhere), an
    empty role fits nowhere either, a null ``conv_id`` is a conversation like any other. Without
    rows after the damage all counts are 0, the audit is empty and the hash is that of nothing.

    Conversations are dealt into blocks of about ``block_rows`` rows. Each block's rows pass twice in
    one sorted shuffle: as codes of a few bytes, then with their texts. The chain of SHA-256 over
    a conversation's text cannot be cut, so a conversation passes through one task; it passes row by
    row, and its paths are found in segments of ``SEGMENT`` rows, so that memory per row stays at
    those few bytes and the audit, which one cell of the result holds anyhow.
    """
    blocks = rows.count() // block_rows + 1
    hurt = damaged(rows)
    block = F.pmod(F.xxhash64("conv_id"), F.lit(blocks)).cast("int")
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    fault = F.when(F.col("copies") == 0, -1).when(end == "", 1).when(end.isin(".", "!", "?"), 0).otherwise(2)
    codes = [block.alias("block"), F.col("conv_id"), F.col("turn"), F.ascii("role").alias("initial"), fault.alias("fault")]
    codes.append(F.unhex(F.md5(F.concat(F.char_length("role"), F.lit(":"), "role", "text").cast("binary"))).alias("digest"))
    # the first copy of a dropped row is kept as a code, so that its conversation is known
    entry = lambda phase, text: F.struct(F.lit(phase).cast("tinyint").alias("phase"), text.alias("text"))
    without, whole = entry(0, F.lit(None).cast("string")), entry(1, F.col("text"))
    entries = F.when(F.col("copies") == 0, F.array(without)).when(F.col("copies") == 1, F.array(without, whole)).otherwise(F.array(without, without, whole, whole))
    twice = hurt.select(*codes, "role", F.inline(entries))
    order = ["block", "phase", F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    columns = ["block", "phase", "conv_id", "turn", "initial", "fault", "digest", "role", "text"]
    return twice.repartition("block").sortWithinPartitions(*order).select(*columns).mapInArrow(_repaired, RESULT)
