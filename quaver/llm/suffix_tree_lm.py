"""Probabilistic suffix tree over words, trained and applied without a global model in memory.

Symbols are lower-cased words and an end of text. The root's distribution is the
smoothed word frequency, with one unknown word that gets the discounted mass. A
context of any number of words becomes a state if it occurs ``MIN_COUNT`` times and
passes a divergence test against the longest state among its suffixes: the mean gain
in log-likelihood on its own occurrences, each left out in turn, must reach
``MIN_GAIN`` nats. A state's distribution is its counts smoothed towards that of the
suffix. Each token is scored in the longest suffix of its history that is a state.

The tree grows by a level a round until a level has no context to examine; no depth
is fixed. A context is examined if it is frequent, if all but its first and all but
its last word were examined, and if one of the suffixes that are two to ``LOOK`` + 1
words shorter is a state (the root is one). So a test may fail at ``LOOK`` lengths in
a row before growth ends there, and a passage that is copied at length ends it, too.

The tree grows with the corpus, so it is never gathered. Texts are cut into blocks;
a round sends each block's distinct keys with partial sums to buckets of the key
space and gets them back added up: words first, then contexts with their next symbol,
and with each level the gains of the level before. Gains are whole multiples of
1 / ``GAIN_SCALE`` nats, so that no sum hangs on how rows are dealt. A frequent key
costs one entry a block. A key that one block alone has, or that no training text
has, is not sent in longer contexts: its block knows their counts. Buckets number
the keys that may become contexts; in the levels to ``CARRY`` a context's and a
word's number make the key, scrambled, of as many bits as it takes, and gains go by
the number to the bucket that gave it, for one bit. Replies and states are stored in
the blocks' buckets and joined there, so replies are shuffled once and states never.
A block finds its states anew from all replies in the first rounds; from level
``CARRY`` on it keeps what the positions that can still grow have reached, a value
for each distinct key, and its texts' sums over the rest.

Words, and contexts beyond level ``CARRY``, are compared by 64-bit hashes.

Defined results: a null or empty text is its end alone. The training part is
picked by the id's text, a null id counting as an empty one (held out). Repeated
rows are separate texts. Without training texts the unknown word has
probability 1. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm import exchange
from quaver.llm.common import forget, stored
from quaver.llm.textarrays import NOT_WHITE, Words, mix, text_slices

BLOCK_BYTES = 4 << 20
#: Occurrences that a context needs, in a corpus of any size.
MIN_COUNT = 12
#: Strength of the parent in a state, nats of the test, discount of the root.
PRIOR, MIN_GAIN, DISCOUNT = 4.0, 0.02, 0.5
#: Lengths at which the test may fail in a row before growth ends.
LOOK = 2
GAIN_SCALE = 4096
#: Level from which states are carried from round to round.
CARRY = 3
END = np.uint64(0x45D9F3B3335B369)
BLOCK = "block string, doc_ids array<long>, lengths array<long>, words binary, tokens binary, size long"
REPLY = "block string, bucket int, numbers binary, ranks binary, total long, known long, width long"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_states long, depth int"


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, offsets, data in text_slices(batch.column(1), block_bytes):
            words = Words(offsets, data, NOT_WHITE)
            docs = len(offsets) - 1
            tokens = np.full(len(words.hash) + docs, END)
            tokens[np.arange(len(words.hash)) + words.doc] = words.hash
            unique, local = np.unique(tokens, return_inverse=True)
            row = [f"{task}-{seq}", ids[first : first + docs], np.diff(words.first) + 1, exchange.packed(unique), exchange.packed(local.astype(np.uint32)), len(tokens)]
            seq += 1
            types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=["block", "doc_ids", "lengths", "words", "tokens", "size"])


def _spread(values: np.ndarray, bits: int) -> np.ndarray:
    """A bijective scrambling of values of so many bits, as the top bits of keys."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(max(1, bits // 2))
    for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        values = values ^ (values >> half)
        values = (values * np.uint64(factor)) & mask
    return (values ^ (values >> half)) << np.uint64(64 - bits)


class Block:
    """One block's tokens, and the states that its positions have reached."""

    def __init__(self, row):
        self.name = row.block
        self.doc_ids = [None if x is None or x != x else int(x) for x in row.doc_ids]
        self.lengths = np.asarray(row.lengths, np.int64)
        self.words, self.local = exchange.unpacked(row.words, np.uint64), exchange.unpacked(row.tokens, np.uint32).astype(np.int64)
        self.held = np.array([held_out(d) for d in self.doc_ids], bool)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.train = ~self.held[self.doc]

    def words_message(self, buckets: int) -> pd.DataFrame:
        return exchange.messages(self.name, self.words, np.bincount(self.local[self.train], minlength=len(self.words)).astype(np.int64), buckets)

    def begin(self, reply: Reply, total: int, known: int) -> None:
        """Root distribution; the words are the keys of level 0."""
        n = len(self.local)
        self.at, self.key, self.hash = np.arange(n), self.local, self.words
        self.seen, self.shut, self.number = reply.counts, reply.alone | (reply.counts == 0), reply.numbers
        self.word_number = self.number
        count = self.seen[self.local]
        root = np.where(count > 0, count - DISCOUNT, DISCOUNT * known) / max(total, 1) if known else np.ones(n)
        # Probability in the longest state, and the same with the position itself left out.
        self.p, self.q = root, root.copy()
        self.state = np.zeros(n, np.int32)
        self.level = 0
        docs = len(self.lengths)
        base = np.log10((count + 0.1) / (total + 0.1 * (known + 1)))
        self.sums = {
            "n_known": np.bincount(self.doc, count > 0, docs).astype(np.int64),
            "base_score": np.bincount(self.doc, base, docs),
            "score": np.zeros(docs),
            "n_states": np.zeros(docs, np.int64),
            "depth": np.zeros(docs, np.int32),
        }
        self.unsummed = self.at

    def longer(self):
        """Positions whose context of one word more is examined, the place of that context among this level's keys, and their own key's."""
        # A context is the key of its last word after the words before it.
        before = np.full(len(self.local) + 1, -1, np.int64)
        before[self.at + 1] = self.key
        context = before[self.at]
        good = context >= 0
        if self.level == 0:
            good[1:] &= self.doc[1:] == self.doc[:-1]
        else:
            good &= self.state[self.at] >= self.level - LOOK
        good[good] = self.seen[context[good]] >= MIN_COUNT
        return self.at[good], context[good], self.key[good]

    def keys(self, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        return mix(context + self.words[self.local[at]] * np.uint64(0xC2B2AE3D27D4EB4F))

    def summed(self, positions: np.ndarray) -> dict[str, np.ndarray]:
        """Sums by text over what ended before and over ``positions``."""
        docs, doc, state = len(self.lengths), self.doc[positions], self.state[positions]
        depth = self.sums["depth"].copy()
        np.maximum.at(depth, doc, state)
        return self.sums | {
            "score": self.sums["score"] + np.bincount(doc, np.log10(self.p[positions]), docs),
            "n_states": self.sums["n_states"] + np.bincount(doc, state > 0, docs).astype(np.int64),
            "depth": depth,
        }

    def saved(self) -> bytes:
        """Everything that ``restore`` needs: contexts with their next symbol decide all but the places."""
        first = np.zeros(len(self.hash), np.int64)
        first[self.key] = np.arange(len(self.at))
        at, going = self.at[first], np.zeros(len(self.local), bool)
        going[self.at] = True
        sums = self.summed(self.unsummed[~going[self.unsummed]])
        values = [self.p[at], self.q[at], self.seen, self.size[self.own[first]], self.state[at], self.shut, self.lone[self.own[first]]]
        values += [np.diff(self.number[(self.seen >= MIN_COUNT) & ~self.shut], prepend=0), np.diff(self.context_number[~self.lone], prepend=0)]
        values += [np.diff(self.at, prepend=0).astype(np.uint32)]
        return pickle.dumps((self.level, [exchange.packed(v) for v in values], sums))

    def restore(self, data: bytes) -> None:
        self.level, values, self.sums = pickle.loads(data)
        kinds = (np.float64, np.float64, np.int64, np.int64, np.int32, bool, bool, np.int64, np.int64, np.uint32)
        p, q, self.seen, size, state, self.shut, lone, numbers, context_numbers, places = [exchange.unpacked(v, k) for v, k in zip(values, kinds)]
        n = len(self.local)
        self.p, self.q, self.state = np.ones(n), np.ones(n), np.zeros(n, np.int32)
        at = self.at = self.unsummed = np.cumsum(places, dtype=np.int64)
        context = self.words[self.local[at - self.level]]
        for back in range(self.level - 1, 0, -1):
            context = self.keys(at - back, context)
        self.hash, self.key = np.unique(self.keys(at, context), return_inverse=True)
        self.p[at], self.q[at], self.state[at] = p[self.key], q[self.key], state[self.key]
        self.contexts, self.own = np.unique(context, return_inverse=True)
        self.size, self.lone = np.zeros(len(self.contexts), np.int64), np.zeros(len(self.contexts), bool)
        self.size[self.own], self.lone[self.own] = size[self.key], lone[self.key]
        self.number, self.context_number = np.full(len(self.hash), -1, np.int64), np.full(len(self.contexts), -1, np.int64)
        self.number[(self.seen >= MIN_COUNT) & ~self.shut] = np.cumsum(numbers)
        self.context_number[~self.lone] = np.cumsum(context_numbers)

    def left_out(self) -> np.ndarray:
        return (np.maximum(self.seen[self.key] - 1, 0) + PRIOR * self.q[self.at]) / (self.size[self.own] - 1 + PRIOR)

    def examine(self, spaces: dict[int, int]) -> None:
        """The numbers of the round: gains of this level's contexts, counts of the next level's with their next symbols."""
        if self.level:
            train = self.train[self.at]
            gain = np.log(self.left_out()[train] / self.q[self.at][train]) - MIN_GAIN
            self.gains = np.bincount(self.own[train], np.rint(gain * GAIN_SCALE), len(self.contexts)).astype(np.int64)
            asked = np.flatnonzero(~self.lone)
            self.asked = asked[np.argsort(self.context_number[asked])]
        at, context, key = self.longer()
        self.next = at, context
        self.next_hash, self.next_key = np.unique(self.keys(at, self.hash[context]), return_inverse=True)
        self.next_seen = np.bincount(self.next_key[self.train[at]], minlength=len(self.next_hash))
        # What no other block has, or no training text, is known without asking; so is all that is longer.
        self.next_shut = np.zeros(len(self.next_hash), bool)
        self.next_shut[self.next_key] = self.shut[key] | self.shut[context]

        self.sent = np.flatnonzero(~self.next_shut)
        self.sent_keys = self.next_hash[self.sent]
        if self.level < CARRY:
            # The context's number and the word's make a shorter key than a hash, and one without equals.
            first = np.zeros(len(self.next_hash), np.int64)
            first[self.next_key] = np.arange(len(at))
            first = first[self.sent]
            pair = self.number[context[first]].astype(np.uint64) * np.uint64(spaces[0]) + self.word_number[self.local[at[first]]].astype(np.uint64)
            keys = _spread(pair, min(64, max(8, (spaces[self.level] * spaces[0]).bit_length())))
            order = np.argsort(keys)
            self.sent, self.sent_keys = self.sent[order], keys[order]

    def messages(self, buckets: int, spaces: dict[int, int]) -> pd.DataFrame:
        rows = exchange.messages(self.name, self.sent_keys, self.next_seen[self.sent], buckets)
        if self.level:
            # A context's sum is made where it was counted.
            bucket, ranks = np.divmod(self.context_number[self.asked], max(1, spaces[self.level - 1] // buckets))
            gains, cuts = self.gains[self.asked], np.searchsorted(bucket, np.arange(buckets + 1))
            more = [
                (buckets + k, self.name, exchange.packed(np.diff(ranks[a:b], prepend=0).astype(np.uint32)), exchange.packed(gains[a:b] << 1 ^ gains[a:b] >> 63))
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
                if b > a
            ]
            rows = pd.concat([rows, pd.DataFrame(more, columns=rows.columns)]) if more else rows
        if not len(rows) and (len(self.next[0]) or self.level and len(self.at)):
            # Nothing to ask, but still growing: an empty message keeps the rounds going.
            rows.loc[0] = (0, self.name, exchange.packed(np.zeros(0, np.uint64)), exchange.packed(np.zeros(0, np.int64)))
        return rows

    def take(self, reply: Reply) -> None:
        """The reply to ``messages``: states of this level, counts of the next."""
        if self.level:
            passed = self.gains >= 0
            passed[self.asked] = reply.passed
            good = passed[self.own]
            at, left_out = self.at[good], self.left_out()[good]
            self.p[at] = (self.seen[self.key[good]] + PRIOR * self.p[at]) / (self.size[self.own[good]] + PRIOR)
            self.q[at] = left_out
            self.state[at] = self.level
        self.at, context = self.next
        # This level's contexts among the last one's keys.
        used = np.zeros(len(self.hash), bool)
        used[context] = True
        self.own = (np.cumsum(used) - 1)[context]
        self.contexts, self.size, self.lone, self.context_number = self.hash[used], self.seen[used], self.shut[used], self.number[used]
        self.hash, self.key, self.seen, self.shut = self.next_hash, self.next_key, self.next_seen.astype(np.int64), self.next_shut
        self.number = np.full(len(self.hash), -1, np.int64)
        self.seen[self.sent], self.number[self.sent] = reply.counts, reply.numbers
        self.shut[self.sent] = reply.alone | (reply.counts == 0)
        self.level += 1

    def scores(self) -> pd.DataFrame:
        sums = self.summed(self.unsummed)
        return pd.DataFrame({"doc_id": pd.array(self.doc_ids, "Int64"), "held_out": self.held, "n_tokens": self.lengths} | sums)


class Reply:
    """What a block gets in a round: ``counts``, ``alone`` and ``numbers`` for the keys that it sent, ``passed`` for the contexts."""

    def __init__(self, parts, buckets: int, space: int, least: int):
        """``parts``: bucket, values and ranks of each message's reply."""
        parts = sorted(([p["bucket"], p["numbers"], p["ranks"]] for p in parts), key=lambda p: p[0]) if parts is not None else []
        values = np.concatenate([exchange.unpacked(n, np.int64) for k, n, _ in parts if k < buckets] or [np.zeros(0, np.int64)])
        ranks = [np.cumsum(exchange.unpacked(r, np.uint32), dtype=np.int64) + k * (space // buckets) for k, _, r in parts if k < buckets]
        self.counts, self.alone = values >> 1, (values & 1).astype(bool)
        self.numbers = np.full(len(values), -1, np.int64)
        self.numbers[(self.counts >= least) & ~self.alone] = np.concatenate(ranks or [np.zeros(0, np.int64)])
        self.passed = np.concatenate([exchange.unpacked(n, bool) for k, n, _ in parts if k >= buckets] or [np.zeros(0, bool)])


def _tallied(sent: DataFrame, buckets: int, least: int) -> DataFrame:
    """Replies of each block. Buckets from ``buckets`` on have gains, by ranks of contexts; the others counts, by keys."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        kind = np.uint64 if bucket < buckets else np.uint32
        keys = [np.cumsum(exchange.unpacked(k, kind), dtype=kind) for k in frame["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        numbers = np.concatenate([exchange.unpacked(n, np.int64) for n in frame["numbers"]])
        parts = list(zip(frame["block"], np.concatenate([[0], ends[:-1]]), ends))
        if bucket >= buckets:
            passed = np.bincount(place, (numbers >> 1) ^ -(numbers & 1), len(distinct)) >= 0
            out = [(block, bucket, exchange.packed(passed[place[a:b]]), b"", 0, 0, 0) for block, a, b in parts]
        else:
            sums = np.bincount(place, numbers, len(distinct)).astype(np.int64)
            alone = np.bincount(place, minlength=len(distinct)) == 1
            common = (sums >= least) & ~alone
            rank, values = np.cumsum(common) - 1, sums << 1 | alone
            out = []
            for block, a, b in parts:
                own = place[a:b]
                ranks = np.diff(rank[own[common[own]]], prepend=0).astype(np.uint32)
                out.append((block, bucket, exchange.packed(values[own]), exchange.packed(ranks), 0, 0, 0))
            out.append((None, bucket, b"", b"", int(sums.sum()), int((sums > 0).sum()), int(common.sum())))
        return pd.DataFrame(out, columns=["block", "bucket", "numbers", "ranks", "total", "known", "width"])

    replies = F.collect_list(F.struct("bucket", "numbers", "ranks")).alias("replies")
    return sent.groupBy("bucket").applyInPandas(run, REPLY).groupBy("block").agg(replies, F.sum("total").alias("total"), F.sum("known").alias("known"), F.max("width").alias("width"))


def score_texts(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Train on the rows that are not held out and score all; ``docs`` has ``doc_id``.

    Besides the scores: ``n_states``, tokens scored below the root, and ``depth``, the
    words of the longest state used.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    columns = ("doc_ids", "lengths", "words", "tokens")
    with ExitStack() as held:

        def kept(df: DataFrame, tag: str) -> tuple[DataFrame, ExitStack]:
            """A table in the blocks' buckets, so that what is joined to them is not shuffled again, and what closes it."""
            stack = held.enter_context(ExitStack())
            return stack.enter_context(exchange.block_table(df, tag)), stack

        blocks, _ = kept(rows.mapInArrow(lambda batches: _blocks(batches, block_bytes), BLOCK), "lm_blocks")
        tokens = blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        buckets = exchange.bucket_count(tokens)
        answers, last = kept(_tallied(exchange.sent_by(blocks, columns, lambda row: Block(row).words_message(buckets)), buckets, 1), "lm_words")
        total, known = exchange.totals(answers)
        rounds, states, replies, live = 0, None, {0: answers}, [last]

        def space(table: DataFrame) -> int:
            """Keys that have numbers are fewer than this; buckets have equal shares."""
            return buckets * (table.agg(F.max("width")).first()[0] or 0)

        spaces = {0: space(answers)}
        forget()

        def met(function, schema: str) -> DataFrame:
            """``function`` of each block with its state and its replies of the rounds that are still read."""
            beside = [] if states is None else [states.where("bucket = -1").select("block", F.col("numbers").alias("state"))]
            beside += [t.where("block is not null").select("block", F.col("replies").alias(f"replies{r}")) for r, t in replies.items()]
            # The short rows first: a block's own row is copied once. Each block has a state or a reply to its words.
            beside = reduce(lambda a, b: a.join(b.hint("merge"), "block", "left"), beside)
            met = blocks.select("block", *columns).join(beside.hint("merge"), "block", "left")
            last, restored, sizes = rounds, states is not None, dict(spaces)

            def grown(row) -> Block:
                block = Block(row)
                if restored:
                    block.restore(row.state)
                else:
                    block.begin(Reply(row.replies0, buckets, sizes[0], 1), total, known)
                while block.level < last:
                    block.examine(sizes)
                    block.take(Reply(getattr(row, f"replies{block.level + 1}"), buckets, sizes[block.level + 1], MIN_COUNT))
                return block

            def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for row in frame.itertuples():
                        yield function(grown(row))

            return met.mapInPandas(run, schema)

        def send(carried: bool, sizes: dict[int, int], block: Block) -> pd.DataFrame:
            state = [(-1, block.name, b"", block.saved())] if carried else []
            block.examine(sizes)
            rows = block.messages(buckets, sizes)
            return pd.concat([rows, pd.DataFrame(state, columns=rows.columns)]) if carried else rows

        while True:
            sent = met(partial(send, rounds >= CARRY, dict(spaces)), exchange.MESSAGE)
            over = []
            if rounds >= CARRY:
                sent, stack = kept(sent, "lm_states")
                over, live, states, replies = live, [stack], sent, {}
            replies[rounds + 1], stack = kept(_tallied(sent.where("bucket >= 0"), buckets, MIN_COUNT), "lm_level")
            spaces[rounds + 1] = space(replies[rounds + 1])
            live.append(stack)
            for stack in over:
                stack.close()
            forget()
            if replies[rounds + 1].isEmpty():
                break
            rounds += 1

        scores = stored(met(Block.scores, SCORE), "lm-scores")
    return scores.withColumn("train_tokens", F.lit(total).cast("long"))


def op1_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
