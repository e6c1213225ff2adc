"""The registered queries over the given tables, and their SQL."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffixspark.jobs.build_ssa import build
from suffixspark.operators import alphabet, compress, packing, transforms
from suffixspark.operators.suffix_sort import full_then_sample, sort_chunks, sparse_suffix_array
from suffixspark.session import cut, new_folder
from suffixspark.sources.chunks import file_chunks, joined_chunks
from suffixspark.sources.ssa_file import read_header, read_ssa, write_ssa
from suffixspark.sources.texts import as_bytes, sized, symbols

KEYS = {"documents": (["doc_id"], "text"), "benchmark": (["item_id"], "text"), "conversations": (["conv_id", "turn"], "text"), "pages": (["page_id"], "html")}


def texts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    keys, column = KEYS[table]
    return as_bytes(spark.read.parquet(f"{sf_dir}/{table}.parquet"), keys, column)


def q01_text_length(spark, d):
    return sized(texts(spark, d, "documents"), 3)


def q02_symbol_frequency(spark, d):
    return alphabet.symbol_frequency(texts(spark, d, "documents"))


def q03_alphabet_rank(spark, d):
    return alphabet.alphabet_rank(texts(spark, d, "documents"))


def q04_alphabet_bits(spark, d):
    return alphabet.alphabet_bits(texts(spark, d, "documents"), 3)


def q05_bitpack_s3(spark, d):
    return packing.bitpack(texts(spark, d, "benchmark"), 3)


def q05_bitpack_documents(spark, d):
    return packing.bitpack(texts(spark, d, "documents"), 3)


def q06_suffix_array(spark, d):
    return sparse_suffix_array(texts(spark, d, "benchmark"), 1, "sort")


def q06_suffix_array_conversations(spark, d):
    return sparse_suffix_array(texts(spark, d, "conversations"), 1)


def q07_ssa_full_then_sample(spark, d):
    return full_then_sample(texts(spark, d, "benchmark"), 3)


def q08_ssa_packed(spark, d):
    return sparse_suffix_array(texts(spark, d, "conversations"), 3)


def q08_ssa_documents(spark, d):
    return sparse_suffix_array(texts(spark, d, "documents"), 3)


def q08_ssa_pages(spark, d):
    return sparse_suffix_array(texts(spark, d, "pages"), 5)


def _compressed(spark, d, table):
    text, keys = texts(spark, d, table), KEYS[table][0]
    headers = compress.header(sized(text, 3), 3)
    return compress.compress(sparse_suffix_array(text, 3), headers, keys), headers, keys


def q09_ssa_compressed_words(spark, d):
    return _compressed(spark, d, "benchmark")[0]


def q09_ssa_compressed_documents(spark, d):
    return _compressed(spark, d, "documents")[0]


def q10_ssa_decompressed(spark, d):
    return compress.decompress(*_compressed(spark, d, "benchmark"))


def q10_ssa_decompressed_documents(spark, d):
    return compress.decompress(*_compressed(spark, d, "documents"))


def q11_ssa_header(spark, d):
    return compress.header(sized(texts(spark, d, "benchmark"), 3), 3)


def _joined(spark, d, s):
    """All of benchmark as one text, in small chunks."""
    return joined_chunks(texts(spark, d, "benchmark"), "item_id", b"-", b"$", 1 << 10, max(62, s))


def q12_ssa_single_text(spark, d):
    """All of benchmark as one text, sorted by distributed doubling."""
    return sort_chunks(_joined(spark, d, 3), 3)


def q12_ssa_single_text_wide(spark, d):
    """The same with cells of 30 symbols: more than 62 bits, so that cells are named by their pieces."""
    return sort_chunks(_joined(spark, d, 30), 30)


def q12_ssa_joined_conversations(spark, d):
    """All turns as one text."""
    rows = texts(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("at"), "content")
    return sort_chunks(joined_chunks(rows, "at", b"-", b"$", 1 << 16), 3)


def q13_fixed_ranks(spark, d):
    return alphabet.fixed_ranks(symbols(texts(spark, d, "benchmark")))


def _mounted(spark) -> str:
    """A new folder in the shared one, by the path that executors open."""
    folder = new_folder(spark, "ssa").removeprefix("file://")
    os.makedirs(folder)
    return folder


def _file_of_benchmark(spark, d, compressed):
    """All of benchmark as one text: its suffix array written as a file in the shared folder, read back."""
    sa = cut(q12_ssa_single_text(spark, d).withColumn("one", F.lit(0)))
    size = sa.agg(F.count("*").alias("cells")).select(F.lit(0).alias("one"), "cells")
    head = compress.header(size, 3, compressed)
    of = head.first()
    path = f"{_mounted(spark)}/benchmark.ssa"
    words = compress.compress(sa, head, ["one"]) if compressed else sa.select("one", F.col("rank").alias("word_idx"), F.col("pos").alias("word"))
    write_ssa(words, path, of.bits_per_element, 3, of.sa_length)
    return read_ssa(spark, path).withColumn("one", F.lit(0)), head


def q14_ssa_file(spark, d):
    return compress.decompress(*_file_of_benchmark(spark, d, True), ["one"]).select("rank", "pos")


def q14_ssa_file_raw(spark, d):
    return _file_of_benchmark(spark, d, False)[0].select(F.col("word_idx").alias("rank"), F.col("word").alias("pos"))


def q15_bitpack_wide(spark, d):
    return packing.bitpack_wide(texts(spark, d, "benchmark"), 13)


def q16_file_chunks(spark, d):
    """The bytes of the file of conversations, read as chunks by byte ranges."""
    chunks = file_chunks(spark, f"{d}/conversations.parquet", 10_000, 7)
    return chunks.select("offset", F.octet_length("content").cast("long").alias("n_bytes"), F.md5(F.hex("content")).alias("content_md5"), F.md5(F.hex("after")).alias("after_md5"))


def q17_build_file(spark, d):
    """The program on the bytes of conversations, as one text if the table has several files: its compressed suffix array, read back and unpacked."""
    path = f"{_mounted(spark)}/conversations.ssa"
    build(spark, f"{d}/conversations.parquet", path, 5, compressed=True, joined=True)
    bits, s, length = read_header(path)
    head = spark.createDataFrame([(0, bits, s, length)], "one int, bits_per_element long, sparseness long, sa_length long")
    return compress.decompress(read_ssa(spark, path).withColumn("one", F.lit(0)), head, ["one"]).select("rank", "pos")


def q18_ssa_wide_cells(spark, d):
    return sparse_suffix_array(texts(spark, d, "conversations"), 13)


def q19_bwt(spark, d):
    """-1 at the primary index."""
    return transforms.bwt(texts(spark, d, "benchmark")).fillna(-1, "byte")


def q19_bwt_primary_index(spark, d):
    return transforms.primary_index(transforms.bwt(texts(spark, d, "conversations")))


def q19_bwt_sampled_index(spark, d):
    return transforms.sampled_index(sparse_suffix_array(texts(spark, d, "conversations"), 1), 8)


def q20_inverse_bwt(spark, d):
    return transforms.inverse_bwt(transforms.bwt(texts(spark, d, "benchmark")))


def q21_lcp(spark, d):
    return transforms.lcp(texts(spark, d, "benchmark"))


QUERIES = {name: f for name, f in sorted(globals().items()) if name[0] == "q" and name[1:3].isdigit()}


def _hex(table: str, keys: str, column: str = "text") -> str:
    return f"h as (select {keys}, hex(encode({column})) h from {table} where {column} is not null)"


def _symbols(table: str, keys: str) -> str:
    return f"{_hex(table, keys)}, ch as (select {keys}, pos, ('0x' || substr(h, 2 * pos + 1, 2))::bigint as byte from (select *, unnest(range(0, length(h) // 2)) pos from h))"


def _suffixes(table: str, keys: str, s: int) -> str:
    return f"""with {_hex(table, keys)}, e as (select *, unnest(range(0, length(h) // 2, {s})) pos from h)
        select {keys}, pos, row_number() over (partition by {keys} order by substr(h, 2 * pos + 1)) - 1 as rank from e"""


def _long_suffixes(table: str, keys: str, s: int, column: str) -> str:
    """The same for long texts: whole suffixes are compared only where their first 64 bytes are equal."""
    return f"""with {_hex(table, keys, column)}, e as (select {keys}, h, unnest(range(0, length(h) // 2, {s})) pos from h), f as (select {keys}, pos, substr(h, 2 * pos + 1, 128) as near from e),
        g as (select {keys}, pos, near, count(*) over (partition by {keys}, near) as n from f),
        w as (select {keys}, pos, near, null as rest from g where n = 1 union all select {keys}, pos, near, substr(h, 2 * pos + 129) from g join h using ({keys}) where n > 1)
        select {keys}, pos, row_number() over (partition by {keys} order by near, rest) - 1 as rank from w"""


_FREQUENCY = "select doc_id, byte, count(*) as cnt from ch group by 1, 2"
_WIDTH = "case when count(*) <= 1 then 0 else length(bin(count(*) - 1)) end::bigint"

def _header(table: str, key: str) -> str:
    return f"hd as (select {key}, cells, length(bin(greatest(cells * 3, 1)))::bigint as bits from (select {key}, (strlen(text) + 2) // 3 as cells from {table} where text is not null))"


def _packed(table: str, key: str) -> str:
    return f"""with {_symbols(table, key)}, al as (select {key}, byte, row_number() over (partition by {key} order by byte) - 1 as rank from (select distinct {key}, byte from ch)),
        bt as (select {key}, {_WIDTH} as bpc from al group by 1)
        select {key}, pos // 3 as cell, sum(rank << (bpc * (3 - 1 - pos % 3)))::bigint as code from ch join al using ({key}, byte) join bt using ({key}) group by 1, 2"""


def _words(table: str, key: str, suffixes: str) -> str:
    return f"""with sa as ({suffixes}), {_header(table, key)},
        bs as (select {key}, string_agg(lpad(bin(pos), bits::int, '0'), '' order by rank) b from sa join hd using ({key}) group by 1),
        w as (select {key}, unnest(range(0, (length(b) + 63) // 64)) word_idx, b from bs),
        c as (select {key}, word_idx, rpad(substr(b, word_idx * 64 + 1, 64), 64, '0') c from w)
        select {key}, word_idx, sum(case when substr(c, i + 1, 1) = '0' then 0::hugeint when i = 0 then -9223372036854775808::hugeint else 1::hugeint << (63 - i)::int end)::bigint as word
        from (select *, unnest(range(0, 64)) i from c) group by 1, 2"""


def _of_one(text: str, s: int) -> str:
    """The suffix array of one text, given as SQL of a table (h): whole suffixes are compared only where their first 64 bytes are equal."""
    return f"""with t as materialized ({text}), e as (select h, unnest(range(0, length(h) // 2, {s})) pos from t), f as (select pos, substr(h, 2 * pos + 1, 128) as near from e),
        g as (select pos, near, count(*) over (partition by near) as n from f),
        w as (select pos, near, null as rest from g where n = 1 union all select pos, near, substr((select h from t), 2 * pos + 129) from g where n > 1)
        select pos, row_number() over (order by near, rest) - 1 as rank from w"""


_JOINED = "select hex(encode(string_agg(text, '-' order by item_id) || '$')) as h from benchmark"
#: The file that the driver's correctness run reads.
_FILE = "select hex(content) as h from read_blob('/root/testdata/sf0.01/conversations.parquet')"

ORACLES = {
    "q01_text_length": "select doc_id, strlen(text) as n_bytes, (strlen(text) + 2) // 3 as cells from documents where text is not null",
    "q02_symbol_frequency": f"with {_symbols('documents', 'doc_id')} {_FREQUENCY}",
    "q03_alphabet_rank": f"with {_symbols('documents', 'doc_id')} select doc_id, byte, row_number() over (partition by doc_id order by byte) - 1 as rank from ({_FREQUENCY})",
    "q04_alphabet_bits": f"""with {_symbols('documents', 'doc_id')}, f as ({_FREQUENCY}), b as (select doc_id, count(*) as alphabet_size, {_WIDTH} as bits_per_char from f group by 1)
        select doc_id, alphabet_size, bits_per_char, bits_per_char * 3 as required_bits,
        case when bits_per_char * 3 <= 8 then 'packed8' when bits_per_char * 3 <= 16 then 'packed16' else 'packed32' end as kernel from b""",
    "q05_bitpack_s3": _packed("benchmark", "item_id"),
    "q05_bitpack_documents": _packed("documents", "doc_id"),
    "q06_suffix_array": _suffixes("benchmark", "item_id", 1),
    "q06_suffix_array_conversations": _suffixes("conversations", "conv_id, turn", 1),
    "q07_ssa_full_then_sample": _suffixes("benchmark", "item_id", 3),
    "q08_ssa_packed": _suffixes("conversations", "conv_id, turn", 3),
    "q08_ssa_documents": _long_suffixes("documents", "doc_id", 3, "text"),
    "q08_ssa_pages": _long_suffixes("pages", "page_id", 5, "html"),
    "q09_ssa_compressed_words": _words("benchmark", "item_id", _suffixes("benchmark", "item_id", 3)),
    "q09_ssa_compressed_documents": _words("documents", "doc_id", _long_suffixes("documents", "doc_id", 3, "text")),
    "q10_ssa_decompressed": _suffixes("benchmark", "item_id", 3),
    "q10_ssa_decompressed_documents": _long_suffixes("documents", "doc_id", 3, "text"),
    "q11_ssa_header": f"with {_header('benchmark', 'item_id')} select item_id, bits as bits_per_element, 3::bigint as sparseness, cells as sa_length, (cells * bits + 63) // 64 as n_words from hd",
    "q12_ssa_single_text": _of_one(_JOINED, 3),
    "q12_ssa_single_text_wide": _of_one(_JOINED, 30),
    "q12_ssa_joined_conversations": _of_one("select hex(encode(string_agg(text, '-' order by conv_id, turn) || '$')) as h from conversations", 3),
    "q14_ssa_file": _of_one(_JOINED, 3),
    "q14_ssa_file_raw": _of_one(_JOINED, 3),
    "q16_file_chunks": f"""with t as ({_FILE}), c as (select h, unnest(range(0, length(h) // 2, 10000)) as "offset" from t), p as (select "offset", substr(h, 2 * "offset" + 1, 20000) as content, substr(h, 2 * "offset" + 20001, 14) as after from c)
        select "offset", length(content) // 2 as n_bytes, md5(content) as content_md5, md5(after) as after_md5 from p""",
    "q17_build_file": _of_one(_FILE, 5),
    "q18_ssa_wide_cells": _suffixes("conversations", "conv_id, turn", 13),
    "q19_bwt": f"""with sa as ({_suffixes('benchmark', 'item_id', 1)}), {_hex('benchmark', 'item_id')}, a as (select item_id, rank + 1 as idx, pos as place from sa union all select item_id, 0, length(h) // 2 from h where length(h) > 0)
        select item_id, idx, case when place > 0 then ('0x' || substr(h, 2 * place - 1, 2))::bigint else -1 end as byte from a join h using (item_id)""",
    "q19_bwt_primary_index": f"with sa as ({_suffixes('conversations', 'conv_id, turn', 1)}) select conv_id, turn, rank + 1 as primary_index from sa where pos = 0",
    "q19_bwt_sampled_index": f"with sa as ({_suffixes('conversations', 'conv_id, turn', 1)}) select conv_id, turn, pos // 8 as sample, rank + 1 as idx from sa where pos % 8 = 0",
    "q20_inverse_bwt": f"with {_symbols('benchmark', 'item_id')} select item_id, pos, byte from ch",
    "q21_lcp": f"""with sa as ({_suffixes('benchmark', 'item_id', 1)}), {_hex('benchmark', 'item_id')}, b as (select item_id, rank, pos, lag(pos) over (partition by item_id order by rank) as before from sa),
        x as (select item_id, rank, pos, substr(h, 2 * pos + 1) as x, substr(h, 2 * before + 1) as y from b join h using (item_id))
        select item_id, rank, pos, coalesce(list_position(list_transform(range(least(length(x), length(y)) // 2 + 1), lambda k: coalesce(substr(x, 2 * k + 1, 2) = substr(y, 2 * k + 1, 2) and 2 * k < least(length(x), length(y)), false)), false) - 1, 0)::bigint as lcp from x""",
    "q15_bitpack_wide": f"""with {_symbols('benchmark', 'item_id')}, al as (select item_id, byte, row_number() over (partition by item_id order by byte) - 1 as rank from (select distinct item_id, byte from ch)),
        bt as (select item_id, {_WIDTH} as bpc, 62 // greatest({_WIDTH}, 1) as take from al group by 1),
        p as (select *, pos // 13 as cell, (pos % 13) // take as piece from ch join al using (item_id, byte) join bt using (item_id))
        select item_id, cell, piece, sum(rank << (bpc * (least(13, (piece + 1) * take) - 1 - pos % 13)))::bigint as code from p group by 1, 2, 3""",
    "q13_fixed_ranks": f"""with {_symbols('benchmark', 'item_id')} select item_id, pos, case byte when 36 then 0 when 45 then 1 else byte - 65 + 2 end::bigint as rank_aa,
        case byte when 67 then 1 when 71 then 2 when 84 then 3 else 0 end::bigint as rank_dna from ch""",
}
