"""N-gram Jaccard join: a grouped prefix join over word shingles.

1. Shingles of each distinct set are counted over all sets. Only shingles of two sets or
   more go back to their sets; a pair can share no others.
2. With shingles ordered by how many sets hold them, two similar sets share one of their
   first ``n - ceil(t n) + 1``. Sets with the same size and the same prefix form a group.
3. Groups that share a prefix shingle form a run. Each run's pivot is paired with the run's
   other groups of fitting size; group pairs are expanded to members and verified by the
   shingles themselves, taken from the texts.
4. Runs whose members are not yet known to be one component are compared completely, in
   blocks of bounded size, by bitmaps that bound the overlap from above. Of the pairs that
   pass, a spanning forest leaves a task and is verified exactly. A run comes again, and
   sends more, as long as one of its pairs was rejected.

So hot shingles and large groups of copies never become pairs of rows, and no link between
two different sets is lost. Hashes propose; texts decide every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm.postings import PACKED, Packer, bucket_of, buckets_for, by_bucket, from_planes, from_steps, hash_words, long, mix, planes, short, sorted_runs, steps_of, text_chunks, unpack, windows
from siltwork.llm.shared import Steps, connected_components, expand, squeeze

SHINGLE = 5
BLOCK_SETS = 4096
BLOCK_BYTES = 8_000_000
LEAST_BITS = 256


def similar(shared: int, a: int, b: int) -> bool:
    """A Jaccard similarity of 0.8 or more."""
    return 100 * shared >= 80 * (a + b - shared)


def prefix_length(n: np.ndarray | int):
    return n - (4 * n + 4) // 5 + 1


def shingle_keys(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles."""
    hashes, at = hash_words(texts, fold=True)
    all_windows = windows(hashes, SHINGLE)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        keys = np.sort(all_windows[a : b - SHINGLE + 1] if b - a >= SHINGLE else windows(hashes[a:b], max(b - a, 1)))
        yield keys[np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0]


def shingles_of(text: bytes) -> set[bytes]:
    """The distinct shingles of a text, word by word."""
    words = text.lower().split()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))} if words else set()


def names_of(text: bytes, bits: int) -> tuple[int, int]:
    """Two independent names of a text's sequence of words, A-Z as a-z: of so many bits, and of 64."""
    digest = blake2b(b" ".join(text.lower().split()), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True) >> 64 - bits, int.from_bytes(digest[8:], "little", signed=True)


REPLIES = "part int, bucket int, sets binary, sizes binary, runs binary, codes binary, counts binary"


def _repeated(table: pa.Table, buckets: np.ndarray) -> pa.Table:
    """Of each set its shingles in this bucket that other sets hold too, with the magnitudes of
    their counts. Sets of one part, as many parts as buckets, share a row."""
    bucket = table.column("bucket")[0].as_py()
    sets, sizes, keys, run = unpack(table)
    order, begins = sorted_runs(keys)
    length = np.diff(begins)
    places = order[np.repeat(length > 1, length)]
    key, owner, size = keys[places], sets[run[places]], sizes[run[places]]
    order = np.lexsort((owner, key))
    key, owner, size = key[order], owner[order], size[order]
    if len(key):
        fresh = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
        key, owner, size = key[fresh], owner[fresh], size[fresh]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.repeat(np.diff(np.r_[begins, len(key)]), np.diff(np.r_[begins, len(key)]))
        often = count > 1
        key, owner, size, count = key[often], owner[often], size[often], count[often]
    else:
        count = np.zeros(0, np.int64)
    part = bucket_of(mix(owner.astype(np.uint64)), len(buckets))
    order = np.lexsort((owner, part))
    key, owner, size, part, count = key[order], owner[order], size[order], part[order], np.frexp(count[order])[1].astype(np.uint8)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        begins = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1]])
        who = owner[a:b][begins]
        rows.append((int(buckets[part[a]]), bucket, steps_of(who), planes(size[a:b][begins].astype(np.int32)), planes(np.diff(np.r_[begins, b - a]).astype(np.int32)), short(key[a:b]), count[a:b].tobytes()))
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "bucket", "sets", "sizes", "runs", "codes", "counts"])


def _prefixes(table: pa.Table) -> pa.Table:
    """Sets whose prefix holds a shared shingle: group, prefix, and all shared shingles sorted."""
    names, sizes, codes, counts = [], [], [], []
    for r in table.to_pylist():
        runs = from_planes(r["runs"], np.int32)
        names.append(np.repeat(from_steps(r["sets"]), runs))
        sizes.append(np.repeat(from_planes(r["sizes"], np.int32), runs))
        codes.append(long(r["codes"]) ^ (np.uint64(r["bucket"]) << np.uint64(48)))
        counts.append(np.frombuffer(r["counts"], np.uint8))
    name, size, code, count = (np.concatenate(v) for v in (names, sizes, codes, counts))
    rarest, by_code = np.lexsort((code, count, name)), np.lexsort((code, name))
    name = name[by_code]
    begins = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    rows: list[tuple] = []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(name)]):
        n = int(size[by_code[a]])
        first = int(prefix_length(n)) - (n - (b - a))
        if first <= 0:
            continue
        leading, group = code[rarest[a : min(b, a + first)]], int(name[a])
        if n == b - a:
            group = int((mix(leading).sum(dtype=np.uint64) + np.uint64(n)).astype(np.int64))
        rows.append((int(name[a]), n, group, leading.astype(np.int64), code[by_code[a:b]].tobytes()))
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["set", "n", "grp", "prefix", "codes"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, mine = None, set()
    for batch in batches:
        fine = []
        for u, ours, theirs in zip(batch.column("u").to_pylist(), batch.column("text"), batch.column("text2")):
            if u != last:
                last, mine = u, shingles_of(expand(ours.as_py()))
            other = shingles_of(expand(theirs.as_py()))
            fine.append(similar(len(mine & other), len(mine), len(other)))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(fine, pa.bool_())], names=["u", "v", "linked"])


def _checked(pairs: DataFrame, bodies: DataFrame, steps: Steps, name: str) -> DataFrame:
    """u, v, linked: the decision about each pair, by the shingles of their texts."""
    left = bodies.select(F.col("set").alias("u"), "text")
    right = bodies.select(F.col("set").alias("v"), F.col("text").alias("text2"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "text", "text2")
    return steps.keep(both.mapInArrow(_verify, "u long, v long, linked boolean"), name)


def bit_width(n: int) -> int:
    """Bits of a set's bitmap: a power of two of four times its size or more."""
    return max(LEAST_BITS, 1 << (4 * n - 1).bit_length())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set, per bit the parity of its shared shingles there, and how many it has."""
    for batch in batches:
        bits, counts = [], []
        for n, codes in zip(batch.column("n").to_pylist(), batch.column("codes").to_pylist()):
            code, width = mix(np.frombuffer(codes, np.uint64)), bit_width(n)
            parity = np.bincount((code & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
            bits.append(np.packbits(parity.astype(np.uint8), bitorder="little").tobytes())
            counts.append(len(code))
        yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("n"), pa.array(counts, pa.int32()), pa.array(bits, pa.binary())], names=["set", "n", "held", "bits"])


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer bits: parities of bits that then coincide."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def _forest(table: pa.Table) -> pa.Table:
    """Pairs of a run that may link and would join components: a spanning forest of them and,
    in later rounds, further ones: per set, a number that grows fourfold with the round."""
    run, i_, j_ = (table.column(c)[0].as_py() for c in ("run", "i", "j"))
    spare = 4 ** table.column("round")[0].as_py() - 1
    order = np.argsort(table.column("n").to_numpy(), kind="stable")
    sets, n, held = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("set", "n", "held"))
    label = np.unique(table.column("label").to_numpy()[order], return_inverse=True)[1]
    bitmaps, linked, rejected = ([table.column(c)[int(k)].as_py() for k in order] for c in ("bits", "linked", "rejected"))
    place = {int(x): k for k, x in enumerate(sets)}

    def join(a: int, b: int) -> None:
        if label[a] != label[b]:
            label[label == label[b]] = label[a]

    for k, partners in enumerate(linked):
        for x in partners or ():
            if x in place:
                join(k, place[x])
    known = label.copy()
    words = np.array([len(b) // 8 for b in bitmaps])
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(words).tolist():  # a partner has the same width or, being larger, twice that
        at = np.flatnonzero((words == w) | (words == 2 * w))
        level[w] = (at, np.stack([_fold(np.frombuffer(bitmaps[k], np.uint64), w) for k in at]))
    u, v = [], []
    for k in range(len(sets) - 1):
        at, bits = level[int(words[k])]
        mine = int(np.searchsorted(at, k))
        end = int(np.searchsorted(at, np.searchsorted(n, 5 * n[k] // 4, side="right")))
        other = at[mine + 1 : end]
        differs = np.flatnonzero(known[other] != known[k]) if spare else np.flatnonzero(label[other] != label[k])
        if not len(differs):
            continue
        other = other[differs]
        differ = np.bitwise_count(bits[mine + 1 : end][differs] ^ bits[mine]).sum(1).astype(np.int64) + (n[k] - held[k]) + (n[other] - held[other])
        total = n[other] + n[k]
        may = other[9 * (total - differ) >= 8 * total]
        no, left = set(rejected[k] or ()), spare
        for p in may.tolist():
            if int(sets[p]) in no:
                continue
            if label[k] != label[p]:
                join(k, p)
            elif left:
                left -= 1
            else:
                continue
            u.append(int(sets[k]))
            v.append(int(sets[p]))
    size = len(u)
    return pa.table({"run": pa.array([run] * size, pa.int64()), "i": pa.array([i_] * size, pa.int32()), "j": pa.array([j_] * size, pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _links(shared: DataFrame, bodies: DataFrame, steps: Steps) -> DataFrame:
    """u, v: links between sets that connect all that are linked."""
    groups = shared.groupBy("grp").agg(F.min("set").alias("rep"), F.min("n").alias("n"), F.min_by("prefix", "set").alias("prefix"))
    postings = groups.select("grp", "rep", "n", F.explode("prefix").alias("code"))
    pivots = postings.groupBy("code").agg(F.min(F.struct("grp", "rep", "n")).alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    run_pairs = postings.join(pivots, "code").where("grp != pivot.grp AND 5 * least(n, pivot.n) >= 4 * greatest(n, pivot.n)")
    group_pairs = run_pairs.select(F.col("pivot.rep").alias("u"), "grp").unionByName(groups.select(F.col("rep").alias("u"), "grp")).distinct()
    pairs = group_pairs.join(shared.select("grp", F.col("set").alias("v")), "grp").where("u != v").select("u", "v")
    links = _checked(pairs, bodies, steps, "pairs").where("linked").select("u", "v")

    labels = links.groupBy(F.col("v").alias("set")).agg(F.min("u").alias("label"))
    labelled = shared.select("set", "n", "grp", "prefix").join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    members = labelled.select("set", "n", "label", F.explode(F.array_append("prefix", F.col("grp"))).alias("run"))
    runs = members.groupBy("run").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.greatest("n", F.lit(LEAST_BITS // 8)).cast("long")).alias("bytes"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("set")).alias("x"), F.min("set").alias("a"), F.max("set").alias("b")
    )
    # Runs of the same sets are one; a run of two sets was its pivot's pair.
    open_runs = runs.where("c > 2 AND low != high").groupBy("c", "bytes", "x", "a", "b").agg(F.min("run").alias("run"))
    blocks = open_runs.select("run", F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(blocks, "run").withColumn("mine", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.select("run", "set", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("run", "set", "label", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"))
    dealt = steps.keep(dealt, "dealt")
    if dealt.isEmpty():
        return links
    bitmaps = shared.select("set", "n", "codes").mapInArrow(_bitmaps, "set long, n int, held int, bits binary")

    decided, turn = None, 0
    while True:
        full = dealt.join(bitmaps, "set")
        if decided is None:
            known = full.withColumns({c: F.lit(None).cast("array<long>") for c in ("linked", "rejected")})
        else:
            both = decided.unionByName(decided.select(F.col("v").alias("u"), F.col("u").alias("v"), "linked"))
            lists = both.groupBy(F.col("u").alias("set")).agg(F.collect_list(F.when(F.col("linked"), F.col("v"))).alias("linked"), F.collect_list(F.when(~F.col("linked"), F.col("v"))).alias("rejected"))
            known = full.join(lists, "set", "left")
        found = known.withColumn("round", F.lit(turn)).groupBy("run", "i", "j").applyInArrow(_forest, "run long, i int, j int, u long, v long")
        found = steps.keep(found, f"found{turn}")
        checked = _checked(found.select("u", "v").distinct(), bodies, steps, f"checked{turn}")
        links = links.unionByName(checked.where("linked").select("u", "v"))
        refused = checked.where("NOT linked").select("u", "v")
        again = found.join(refused, ["u", "v"], "left_semi").select("run", "i", "j").distinct()
        if again.isEmpty():
            return links
        decided = checked if decided is None else decided.unionByName(checked)
        dealt, turn = steps.keep(dealt.join(again, ["run", "i", "j"], "left_semi"), f"dealt{turn}"), turn + 1


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", name_bits: int = 64) -> DataFrame:
    """key, n_shingles, component_id: of each document the smallest id reachable by links.

    A document's set: the distinct runs of five words (A-Z as a-z, words without ASCII white
    space); with fewer words the whole sequence; without words or text nothing, and then it
    links with nothing. Two documents link from a Jaccard similarity of 0.8. Rows of one id
    stay rows; a null id is passed over as a component's name while another is there. Other
    columns are ignored. An empty table gives an empty result. Texts of one sequence of words
    are one set, told apart by 64 bits of BLAKE2b and ``name_bits`` more. Links between sets are
    decided by the shingles of their texts; hashes of 48 bits and a bucket only propose them.
    """
    steps = Steps(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch):
                sizes = [len(keys) for keys in shingle_keys(texts)]
                names = [names_of(t, name_bits) if n else (None, None) for n, t in zip(sizes, texts)]
                columns = [pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([squeeze(t) for t in texts], pa.binary())]
                rows = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc"), pa.array(sizes, pa.int64()), *columns], names=["row", "doc", "n_shingles", "name", "name2", "n_bytes", "text"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            names = batch.column("set").to_pylist()
            for start, texts in text_chunks(batch, read=expand):
                for name, keys in zip(names[start:], shingle_keys(texts)):
                    yield from packer.add(name, keys, len(keys))
        yield from packer.flush()

    measured = steps.keep(given.mapInArrow(measure, "row long, doc long, n_shingles long, name long, name2 long, n_bytes long, text binary"), "measured")
    members = steps.keep(measured.select("doc", "n_shingles", "name", "name2"), "members")
    firsts = measured.where("name IS NOT NULL").groupBy("name", "name2").agg(F.min("row").alias("set"), F.min("doc").alias("first"))
    sets = steps.keep(firsts, "sets")
    bodies = steps.keep(sets.select(F.col("set").alias("row")).join(measured.select("row", "text", "n_bytes"), "row").select(F.col("row").alias("set"), "text", "n_bytes"), "bodies")
    steps.drop("measured")
    buckets = buckets_for(bodies)
    n = len(buckets)
    replies = by_bucket(bodies.select("set", "text").mapInArrow(post, PACKED), n).applyInArrow(lambda t: _repeated(t, buckets), REPLIES)
    whole = replies.repartition(n, "part").groupBy("part").applyInArrow(_prefixes, "set long, n int, grp long, prefix array<long>, codes binary")
    shared = steps.keep(whole, "shared")
    components = connected_components(_links(shared, bodies, steps))
    steps.drop("shared", "dealt", "bodies")
    placed = sets.join(components.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select(F.col("name").alias("__name"), F.col("name2").alias("__name2"), "component_id")
    same = (F.col("name") == F.col("__name")) & (F.col("name2") == F.col("__name2"))
    return members.select("doc", "n_shingles", "name", "name2").join(named, same, "left").select(F.col("doc").alias(key), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-identical documents over whole texts."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
