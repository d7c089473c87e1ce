"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, contamination, jaccard, lines, merkle, packing, pieces, quality, repair, rules, substrings, urls, winnow
from tidemark.llm.checksql import CRC_TABLE, crc32

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


@query("op1_document_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    compared = winnow.compare_with_next(table(spark, folder, "documents", "doc_id", "text"))
    return compared.withColumns({name: winnow.spelled(F.col(name)) for name in ("fingerprint", "edited_fingerprint")})


@query("op2_piece_encoding")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(PIECE_MODEL)
    encoded = pieces.encode(table(spark, folder, "documents", "doc_id", "text"), path)
    digests = encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.array_join(F.concat("begins", "ends").cast("array<string>"), " "), 256).alias("spans_sha256"),
        "ids",
    )
    decoded = pieces.decode(digests, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "spans_sha256")


@query("op3_substring_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents", "doc_id", "text"))


SAYING = "</s>[INST] ok [/INST]"
_MARKS = " + ".join(f"(length(x) - length(replace(x, '{mark}', ''))) // {len(mark)}" for mark in chat.CONTROL)


def _escaped(column: str) -> str:
    return f"(select length(x) + length(x) - length(replace(x, chr(92), '')) + {_MARKS} from (select {column} as x))"


@query("op4_chat_formatting", f"""
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all values (-1, 0, 'user', '{SAYING}'), (-1, 1, 'assistant', '{SAYING}')
    ), sized as (
        select *, {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} + {len(chat.TURN) + 1 + len(chat.CLOSE)} as chars from turns
    )
    select conv_id, count(*) as n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
        coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
        (sum(chars) + {len(chat.BEGIN) + len(chat.END)})::bigint as formatted_chars,
        'messages_text' as layout
    from sized group by conv_id""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", SAYING), (-1, 1, "assistant", SAYING)], turns.schema)
    formatted = chat.format_records(chat.records_of_turns(turns.unionByName(own)), "conv_id", "record")
    layouts = formatted.select("conv_id", "layout", "formatted", "loss_begins", "loss_ends")
    back = chat.read_back(layouts.withColumn("conv_id", F.struct("conv_id", "layout")), "conv_id")
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id.conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "conv_id.layout",
    )


@query("op5_ngram_jaccard_join", r"""
    with recursive d as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
    ), s as (select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by doc_id),
    c as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
    l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * shared >= 75 * (na.n + nb.n - shared)),
    e as (select a, b from l union all select b, a from l),
    r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.b from r join e on e.a = r.other)
    select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, m as component_id
    from d left join n using (doc_id) join (select doc_id, min(other) as m from r group by doc_id) using (doc_id)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents", "doc_id", "text"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents", "doc_id", "text"), public_tokenizers.path(WORD_MODEL))


@query("op7_quality_classifier")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
_RULE_ROWS = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in URL_RULES)


@query("op8_url_filters", f"""
    with rules(verdict, rule, rule_host, rule_path) as (values {_RULE_ROWS}),
    split as (
        select page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as raw,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages
    ), parts as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from split)
    select page_id, host, path, hit.rule as rule, coalesce(hit.verdict, 'allow') as verdict
    from parts left join lateral (
        select rule, verdict from rules
        where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        order by length(rule) desc limit 1
    ) hit on true""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages", "page_id", "url"), urls.ship(spark, URL_RULES))


@query("op9_line_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents", "doc_id", "text"))


@query("op10_quality_rules", r"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    w as (select r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
    g as (select r, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
    twice as (select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from g),
    covered as (select r, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) o(k) where n > 1 group by r),
    s as (
        select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
            (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
            len(lines) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) as n_lower
        from w left join covered using (r)
    ), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not (base_failed or 10 * n_symbols > n_words or n_upper > n_lower or 100 * n_dup_lines > 50 * n_lines or word_chars > 20 * n_words) as kept
    from b""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return rules.judge(table(spark, folder, "documents", "doc_id", "text"))


_SPELLED = " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in merkle.FIELDS)
_LOWERED = _SPELLED.replace("text", f"translate(text, '{merkle.CAPITALS}', '{merkle.SMALL}')")


def _climbed(name: str, start: str) -> str:
    """A recursive table of all nodes of some trees, and beside it each node with its left and right siblings."""
    return f"""
    {name}_nodes(tree, level, pos, n, digest) as (
        {start}
        union all
        select tree, level + 1, pos // 16, any_value(n + 15) // 16, sha256(string_agg(digest, '' order by pos)) from {name}_nodes where n > 1 group by tree, level, pos // 16
    ), {name}_sides as (
        select tree, level, pos, n, digest, coalesce(string_agg(digest, '') over (w rows between unbounded preceding and 1 preceding), '') as before,
            coalesce(string_agg(digest, '') over (w rows between 1 following and unbounded following), '') as after
        from {name}_nodes window w as (partition by tree, level, pos // 16 order by pos)
    )"""


@query("op11_merkle_manifest", f"""
    with recursive {CRC_TABLE}, leaves as (
        select doc_id, coalesce('1' || source, '0') as tree, sha256({_SPELLED}) as leaf,
            case when {crc32("doc_id::varchar")} % 5 = 0 then sha256({_LOWERED}) else sha256({_SPELLED}) end as changed
        from documents, crc_table
    ), placed as (
        select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from leaves
    ), {_climbed("own", "select tree, 0, pos, n, leaf from placed")},
    tops as (select tree as name, digest, row_number() over (order by tree) - 1 as pos, count(*) over () as n from own_nodes where n = 1),
    {_climbed("top", "select '', 0, pos, n, digest from tops")},
    up(doc_id, tree, first_pos, level, pos, folded, proof) as (
        select doc_id, tree, pos, 0, pos, changed, '' from placed
        union all
        select u.doc_id, u.tree, u.first_pos, u.level + 1, u.pos // 16, sha256(s.before || u.folded || s.after), u.proof || s.before || s.after
        from up u join own_sides s on s.tree = u.tree and s.level = u.level and s.pos = u.pos where s.n > 1
    ), joined as (
        select u.*, t.pos as top_pos, t.digest as subroot from up u join own_nodes o on o.tree = u.tree and o.level = u.level and o.n = 1 join tops t on t.name = u.tree
    ), up2(doc_id, tree, first_pos, subroot, level, pos, folded, proof) as (
        select doc_id, tree, first_pos, subroot, 0, top_pos, folded, proof from joined
        union all
        select u.doc_id, u.tree, u.first_pos, u.subroot, u.level + 1, u.pos // 16, sha256(s.before || u.folded || s.after), u.proof || s.before || s.after
        from up2 u join top_sides s on s.level = u.level and s.pos = u.pos where s.n > 1
    )
    select u.doc_id, p.leaf, u.subroot, r.digest as root, sha256(u.proof) as proof_sha256, u.folded as folded_root, u.folded = r.digest as verified
    from up2 u join top_nodes r on r.n = 1 and r.level = u.level join placed p on p.tree = u.tree and p.pos = u.first_pos""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify_documents(table(spark, folder, "documents", *merkle.FIELDS))


def _edge_rows() -> str:
    """The ways to take a row: initial, fault, states, cost, padded letters, rows added before it, its role (null: deleted, empty: as it is)."""
    out = []
    for code, layer in enumerate(repair.ROW_LAYERS):
        initial, fault = repair.INITIALS[code // 4], code % 4
        for state, ways in enumerate(layer):
            for after, cost, digits in ways:
                letters = repair.letters_of(digits)
                added, own, _ = repair.apply_edits(state, letters, initial)
                lines = " || ".join([f"chr(10) || '{role}:'" for role in added] or ["''"])
                role = "null" if own is None else f"'{own}'"
                out.append(f"('{initial}', {fault}, {state}, {after}, {cost}, '{letters:3}', {lines}, {role})")
    return ", ".join(out)


_TAIL_ROWS = ", ".join(
    f"({q}, {repair.COSTS['I'] * len(t)}, '{t}', " + " || ".join([f"chr(10) || '{r}:'" for r in repair.apply_edits(q, t, "")[0]] or ["''"]) + ")" for q, t in enumerate(repair.TAIL)
)


@query("op12_conversation_repair", rf"""
    with recursive {CRC_TABLE}, drawn as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
            {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as act from conversations, crc_table
    ), damaged as (
        select conv_id, turn, case when act = 4 then 'user' else role end as role, case act when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
        from drawn, (values (0), (1)) c(copy) where act <> 0 and (copy = 0 or act = 3)
    ), sealed as (
        select *, coalesce('1' || conv_id, '0') as key, sha256(strlen(role) || ':' || role || text) as seal, left(role, 1) as initial from damaged
    ), placed as (
        select *, row_number() over (partition by key order by turn nulls first, seal) as i from sealed
    ), faulty as (
        select *, lag(initial) over (partition by key order by i) as before, case when not regexp_matches(text, '[^ 	-
]') then 2 when i > min(i) over (partition by key, seal) then 3 when regexp_matches(text, '[.!?][ 	-
]*$') then 0 else 1 end as fault from placed
    ), counted as (
        select key, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank, count(*) filter (fault = 3) as duplicate,
            count(*) filter (fault = 1) as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n
        from faulty group by key
    ), edges(initial, fault, state, after, cost, letters, added, own) as (values {_edge_rows()}),
    ways(key, i, state, best) as (
        select key, 0, 0, {{'cost': 0, 'audit': '', 'text': ''}} from counted
        union all
        select w.key, any_value(w.i + 1), e.after, min({{'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.letters,
            'text': w.best.text || e.added || case when e.own is null then '' else chr(10) || coalesce(nullif(e.own, ''), f.role) || ':' || f.text end}})
        from ways w join faulty f on f.key = w.key and f.i = w.i + 1
        join edges e on e.state = w.state and e.fault = f.fault and e.initial = case when f.initial in ('s', 'u', 'a') then f.initial else '-' end
        group by w.key, e.after
    ), ends as (
        select w.key, min({{'cost': w.best.cost + t.cost, 'audit': w.best.audit || t.letters, 'text': w.best.text || t.added}}) as best
        from ways w join counted c on c.key = w.key and c.n = w.i join (values {_TAIL_ROWS}) t(state, cost, letters, added) on t.state = w.state group by w.key
    )
    select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
        coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(replace(best.audit, ' ', ''), '') as audit, sha256(coalesce(best.text[2:], '')) as repaired_sha256
    from (select distinct conv_id, coalesce('1' || conv_id, '0') as key from conversations) o left join counted using (key) left join ends using (key)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return repair.audit_conversations(repair.damage(turns), turns)


def _words_of(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{merkle.CAPITALS}', '{merkle.SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op13_benchmark_decontamination", f"""
    with d as (select row_number() over () as r, doc_id, {_words_of("text")} as w from documents),
    t as (select coalesce(item_id::varchar, '') as item, {_words_of("text")} as w from benchmark),
    i as (select item, least(len(w), {contamination.WINDOW}) as k, array_to_string(w[j:j + least(len(w), {contamination.WINDOW}) - 1], ' ') as g
        from (select item, w, unnest(range(1, len(w) - least(len(w), {contamination.WINDOW}) + 2)) as j from t where len(w) > 0)),
    g as (select r, k, j, array_to_string(w[j:j + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as j from d, (select distinct k from i) where len(w) >= k)),
    o as (select distinct r, g.k, j, g from g where (k, g) in (select k, g from i)),
    h as (select r, count(distinct p) as n_hit from (select r, unnest(range(j, j + k)) as p from o) group by r),
    f as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from o join i using (k, g) group by r)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join h using (r) left join f using (r)""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    judged = contamination.judge_documents(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))
    return judged.drop("longest")
