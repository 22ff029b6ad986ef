"""Token counts with a linear longest-match automaton.

A trie over the vocabulary has failure links and, at every node, the number of tokens that following the link pops
(Song et al. 2021, "Fast WordPiece Tokenization"), so a word's greedy longest-match length comes from one pass over
its bytes without building the pieces. Words are [^\\x20\\x09-\\x0D]+, each read with one space before it; tokens that
hold other white space never match. Single bytes that the vocabulary lacks count as one token each.

The vocabulary is read on the driver from a file of base64 tokens and ranks, and broadcast: its size is the
vocabulary's, whatever the corpus. Null and empty texts have 0 tokens; rows that repeat are counted alike, words of any
length in one pass, very long texts one by one. Columns besides doc_id and text are left out, so names cannot clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, words_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words whose counts a task remembers, and their longest; the memory is emptied when full.
MEMORY, LONGEST = 200_000, 64


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def automaton(vocabulary: Iterable[bytes]) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges by node * 256 + byte, failure links, and popped-token counts; node 0 is the root."""
    tokens = {t for t in vocabulary if t and (t == b" " or (t[1:] if t[:1] == b" " else t).split() == [t[1:] if t[:1] == b" " else t])}
    tokens |= {bytes([b]) for b in range(256)}
    edges: dict[int, int] = {}
    parent, byte, final = [0], [0], [False]
    for token in sorted(tokens):
        node = 0
        for b in token:
            key = node << 8 | b
            nxt = edges.get(key)
            if nxt is None:
                nxt = edges[key] = len(parent)
                parent.append(node)
                byte.append(b)
                final.append(False)
            node = nxt
        final[node] = True
    depth = [0] * len(parent)
    for v in range(1, len(parent)):  # parents come first
        depth[v] = depth[parent[v]] + 1
    link, popped = [0] * len(parent), [0] * len(parent)
    for v in sorted(range(1, len(parent)), key=depth.__getitem__):
        if final[v]:
            popped[v] = 1
            continue
        z, count = link[parent[v]], popped[parent[v]]
        while (nxt := edges.get(z << 8 | byte[v])) is None:  # ends at the root, which has all bytes
            count += popped[z]
            z = link[z]
        link[v], popped[v] = nxt, count
    return edges, link, popped


def longest_match_count(word: bytes, edges: dict[int, int], link: list[int], popped: list[int]) -> int:
    node = count = 0
    for b in word:
        while (nxt := edges.get(node << 8 | b)) is None:
            count += popped[node]
            node = link[node]
        node = nxt
    while node:
        count += popped[node]
        node = link[node]
    return count


def token_counts(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes of each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary if vocabulary is not None else read_vocabulary()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, link, popped = shared.value
        known: dict[bytes, int] = {}

        def of(word: bytes) -> int:
            if len(word) > LONGEST:
                return longest_match_count(b" " + word, edges, link, popped)
            n = known.get(word)
            if n is None:
                if len(known) >= MEMORY:
                    known.clear()
                n = known[word] = longest_match_count(b" " + word, edges, link, popped)
            return n

        for batch in batches:
            n_words, n_tokens, n_bytes = [], [], []
            for text in batch["text"]:
                text = text.as_py()
                words = words_of(text)
                n_words.append(len(words))
                n_tokens.append(sum(map(of, words)))
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
            yield pa.record_batch([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_bytes))], ["doc_id", "n_words", "n_tokens", "n_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", F.col("text")), counted, f"doc_id {kind}, n_words long, n_tokens long, n_bytes long")


def op5_longest_match_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op5_longest_match_tokens": rf"""
WITH RECURSIVE v AS (SELECT DISTINCT hex(from_base64(token)) AS t FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
h AS (SELECT DISTINCT w, hex(encode(' ' || w)) AS x FROM (SELECT unnest(words) AS w FROM d)),
p AS (SELECT w, x, unnest(range(0, length(x), 2)) AS o FROM h),
c AS (SELECT w, x, o, unnest(range(2, least(length(x) - o, (SELECT max(length(t)) FROM v)) + 1, 2)) AS size FROM p),
m AS MATERIALIZED (SELECT w, o, max(CASE WHEN t IS NOT NULL OR size = 2 THEN size END) AS size FROM c LEFT JOIN v ON substr(x, o + 1, size) = t GROUP BY 1, 2),
g(w, o, n) AS (SELECT w, 0::BIGINT, 0::BIGINT FROM h UNION ALL SELECT g.w, g.o + m.size, n + 1 FROM g JOIN m ON g.w = m.w AND g.o = m.o),
k AS (SELECT w, max(n) AS n FROM g GROUP BY w),
s AS (SELECT doc_id, text, sum(k.n) AS n FROM (SELECT doc_id, text, unnest(words) AS w FROM d) JOIN k USING (w) GROUP BY 1, 2)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_tokens, CAST(octet_length(encode(coalesce(d.text, ''))) AS BIGINT) AS n_bytes
FROM d LEFT JOIN s ON d.doc_id = s.doc_id AND d.text IS NOT DISTINCT FROM s.text
"""
}
