"""One query for each operator here, over whole tables; SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import (
    chat,
    counts,
    jaccard,
    leaks,
    pieces,
    private,
    quality,
    repair,
    rules,
    sequences,
    shards,
    spelling,
    suffixes,
)
from quillon.suite.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"
BYTE_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
SHARDS = 40


def query(job: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[job.__name__] = job
    return job


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL)
    )


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.documents_through_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL)
    )


@query
def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.withColumn("containment", F.round("containment", 6))


# All shingles of all documents against all shingles of all items, without sketches.
SQL["op5_benchmark_leaks"] = r"""
with doc_words as (
    select doc_id, list_filter(
        regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words
    from documents
), item_words as (
    select item_id, list_filter(
        regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words
    from benchmark
), item_rows as (
    select distinct item_id, width, array_to_string(words[i:i + width - 1], ' ') as shingle
    from (
        select item_id, words, least(len(words), 5) as width,
            unnest(generate_series(1, len(words) - least(len(words), 5) + 1)) as i
        from item_words where len(words) > 0
    )
), items as (
    select *, count(*) over (partition by item_id, width) as size from item_rows
), doc_rows as (
    select distinct doc_id, width, array_to_string(words[i:i + width - 1], ' ') as shingle
    from (
        select doc_id, words, width, unnest(generate_series(1, len(words) - width + 1)) as i
        from doc_words, (select distinct width from items) where len(words) >= width
    )
)
select doc_id, item_id, size, count(*) as matched, round(count(*) / size, 6) as containment
from doc_rows join items using (width, shingle)
group by doc_id, item_id, width, size
having count(*) >= ceil(size * 0.8 - 1e-9)
"""


@query
def op6_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


@query
def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_MODEL)
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(hard).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select(*extra.columns).unionByName(extra)
    made = chat.format_conversations(turns).select(
        "conv_id",
        "order_ok",
        chat.formatted_text(F.col("segments")).alias("formatted"),
        chat.read_loss_text(F.col("segments")).alias("loss_text"),
    )
    read = made.withColumn("turns", chat.read_turns(F.col("formatted")))
    said = F.array_join(
        F.transform(
            "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
        ),
        "",
    )
    return read.select(
        "conv_id",
        "order_ok",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


# Written from the contract: digests of the turns themselves, lengths by adding up what the
# template puts around roles and texts and what escaping adds.
SQL["op9_chat_format"] = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
    from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
    select *,
        length('<|' || '|>' || chr(10) || '<|end|>' || chr(10)) + length(role) + length(text)
        + length(regexp_replace(role || text, '[^<>\\]', '', 'g')) as chars,
        coalesce(lag(role) over (partition by conv_id order by turn, role, text), '') || chr(10) || role as step,
        lead(role) over (partition by conv_id order by turn, role, text) is null as at_end
    from turns
)
select
    conv_id,
    bool_and(step in (ALLOWED)) and bool_or(at_end and role in (LAST)) as order_ok,
    count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text))
        as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), ''))
        as loss_sha256,
    cast(sum(chars) as bigint) as formatted_chars
from sized
group by conv_id
"""

SQL["op9_chat_format"] = (
    SQL["op9_chat_format"]
    .replace("ALLOWED", ", ".join(f"'{a}' || chr(10) || '{b}'" for a, nexts in chat.CHAT.follows.items() for b in nexts))
    .replace("LAST", ", ".join(f"'{r}'" for r in chat.CHAT.last))
)


@query
def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults drawn by crc32 of ``conv_id:turn`` (nulls: one space)."""
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space),
    )
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("fault", fault)
    return rows.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    )


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = repair.repair(damaged(turns))
    every = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select(
        "conv_id", repair.conversation_key(F.col("conv_id")).alias("conv")
    )
    rows = every.join(repaired.summary, "conv", "left").join(
        repair.digests(repaired.turns), "conv", "left"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "conv_id",
        *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# Written from the contract. crc32 by its table; then, from the last row of each conversation to
# the first, the cheapest (cost, edits) from each of the four states of the pattern, by recursion.
SQL["op11_conversation_repair"] = r"""
with recursive crc_table as (
    select list(v order by i) as crcs from (
        select i, list_reduce([i] || range(8), lambda c, k:
            case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
        from (select unnest(range(256))::bigint as i)
    )
), keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
    from conversations
), faulted as (
    select conv_id, turn, role, text,
        xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda ch: ascii(ch)::bigint),
            lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295) % 20 as fault
    from keyed, crc_table
), dealt as (
    select conv_id, turn,
        case when fault = 4 then 'user' else role end as role,
        case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(range(case when fault = 3 then 2 else 1 end)) as copy
    from faulted where fault <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i
    from dealt
), judged as (
    select *, left(role, 1) as c, count(*) over (partition by conv_id) as n,
        not regexp_matches(text, '[^ 	-
]') as is_blank,
        row_number() over (partition by conv_id, role, text order by i) > 1 as seen,
        not regexp_matches(regexp_replace(text, '[ 	-
]+$', ''), '[.!?]$') as cut,
        lag(left(role, 1)) over (partition by conv_id order by i) as prior
    from placed
), facts as (
    select conv_id, max(n) as n,
        coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
        count(*) filter (is_blank) as blank,
        count(*) filter (seen and not is_blank) as duplicate,
        count(*) filter (cut and not seen and not is_blank) as truncated,
        count(*) filter (i > 1 and (prior || c) not in ('su', 'ua', 'au')) as illegal
    from judged group by conv_id
), turn_to(q, r, made) as (
    values ('-', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')
), inserts as (
    select q, q as r, 0 as price, '' as done, '' as made from turn_to
    union all
    select q, r, 5, 'I', made || ':' || chr(10) from turn_to
    union all
    select x.q, y.r, 10, 'II', x.made || ':' || chr(10) || y.made || ':' || chr(10)
    from turn_to x join turn_to y on x.r = y.q
), kept(q, c, r) as (
    values ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), walked as (
    select f.conv_id, f.n as i, s.q, s.price::bigint as price, s.done::varchar as done, s.made::varchar as made
    from facts f, inserts s where s.r in ('-', 'a')
        and (s.q, s.price) in (('-', 0), ('s', 10), ('u', 5), ('a', 0))
    union all
    select conv_id, i, q, least.price, least.done, least.made
    from (
        select conv_id, i - 1 as i, q, min({'price': price, 'done': done, 'made': made}) as least
        from (
            select w.conv_id, w.i, s.q, s.price + 2 + w.price as price,
                s.done || 'D' || w.done as done, s.made || w.made as made
            from walked w
            join inserts s on s.r = w.q
            where w.i >= 1
            union all
            select w.conv_id, w.i, s.q, s.price + 5 * j.cut::int + w.price, s.done || 'K' || w.done,
                s.made || j.role || ':' || j.text || chr(10) || w.made
            from walked w
            join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i
            join kept k on k.c = j.c and k.r = w.q
            join inserts s on s.r = k.q
            where not j.is_blank and not j.seen
            union all
            select w.conv_id, w.i, s.q, s.price + 1 + 5 * j.cut::int + w.price, s.done || 'R' || w.done,
                s.made || t.made || ':' || j.text || chr(10) || w.made
            from walked w
            join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i
            join turn_to t on t.r = w.q
            join inserts s on s.r = t.q
            where not j.is_blank and not j.seen
        )
        group by conv_id, i, q
    )
), best as (
    select * from walked where i = 0 and q = '-'
)
select e.conv_id,
    coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
    coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    coalesce(price, 0) as cost, coalesce(done, '') as audit,
    sha256(coalesce(left(made, length(made) - 1), '')) as repaired_sha256
from (select distinct conv_id from conversations) e
left join facts f on e.conv_id is not distinct from f.conv_id
left join best b on e.conv_id is not distinct from b.conv_id
"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=True)


# Written from the contract: near words meet by equal strings after one letter is taken out.
SQL["op12_spelling_variants"] = r"""
with recursive crc_table as (
    select list(v order by i) as crcs from (
        select i, list_reduce([i] || range(8), lambda c, k:
            case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
        from (select unnest(range(256))::bigint as i)
    )
), runs as (
    select coalesce(doc_id::varchar, '') as id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
    from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents)
), hashed as (
    select run, times, xor(list_reduce(
        [4294967295] || list_transform(range(1, length(code), 2), lambda i: ('0x' || substring(code, i, 2))::bigint),
        lambda c, b: xor(c >> 8, crcs[1 + (xor(c, b) & 255)])), 4294967295) as h
    from (select id, run, count(*) as times, hex(id || ':' || run) as code from runs where length(run) >= 6 group by id, run), crc_table
), words as (
    select word, sum(times)::bigint as n
    from (
        select times, case when h % 199 = 0
            then left(run, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word
        from hashed
    )
    where length(word) >= 6
    group by word having sum(times) >= 5
), cuts as (
    select word, n, i, left(word, i - 1) || substring(word, i + 1) as rest
    from (select word, n, unnest(range(1, length(word) + 1))::int as i from words)
), pairs as (
    select a.word, a.n, b.word as near, b.n as near_n
    from cuts a join cuts b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union
    select a.word, a.n, b.word, b.n from cuts a join words b on a.rest = b.word
    union
    select b.word, b.n, a.word, a.n from cuts a join words b on a.rest = b.word
), best as (
    select word, count(*) as n_near, min({'less': -near_n, 'near': near}) as best
    from pairs group by word
), forms as (
    select w.word, w.n, coalesce(n_near, 0) as n_near,
        case when -best.less >= 5 * w.n then best.near end as form,
        case when -best.less >= 5 * w.n then -best.less end as form_n
    from words w left join best b on w.word = b.word
), walk as (
    select word, word as root, form as next from forms
    union all
    select w.word, f.word, f.form from walk w join forms f on f.word = w.next
)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n
from forms f join walk w on f.word = w.word and w.next is null
"""


@query
def op13_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(table(spark, sf_dir, "documents"))
