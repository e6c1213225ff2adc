"""The registered queries of this subpackage, and their SQL."""

from pyspark.sql import functions as F

from suffixspark.llm import alignment, decontaminate, divergence, jaccard, language, licenses, lines, maxent, mixing, phrases, tokens, topk, warc


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_sentences(spark, sf_dir):
    out = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    names = F.array_join("licenses", "|")
    return out.select("row.doc_id", F.size("sentences").cast("long").alias("n_known"), F.array_join("sentences", " ").alias("sentences"), names.alias("licenses"))


def _license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.known_sentences().items())
    rules = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in reversed(dict(reversed(licenses.RULES)).items()))
    split = lambda text: f"string_split(regexp_replace({text}, '([.!?;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))"
    low = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    wrapped = f"regexp_replace({low}, '[\\n\\r]+', ' ', 'g')"
    return f"""
        with known(sentence, name) as (values {table}), rules(seq, license) as (values {rules}),
        d as (select doc_id, {split(low)} as a, {split(wrapped)} as b from documents),
        s as (select doc_id, 'a' as way, unnest(a) as sentence, unnest(range(len(a))) as pos from d union all select doc_id, 'b', unnest(b), unnest(range(len(b))) from d),
        m as (select doc_id, way, pos, name from s join known on known.sentence = trim(regexp_replace(s.sentence, '[^a-z0-9]+', ' ', 'g'), ' ')),
        q as (select doc_id, way, count(*) as n, string_agg(name, ' ' order by pos) as seq from m group by 1, 2),
        best as (select doc_id, arg_max(seq, (n, case way when 'a' then 1 else 0 end)) as seq, max(n) as n from q group by 1),
        x as (select doc_id, n, seq, regexp_extract_all(seq, '\\b(?:{"|".join(k for k, _ in licenses.RULES)})\\b') as found from best),
        l as (select doc_id, string_agg(license, '|' order by i) as licenses from (select doc_id, unnest(found) as f, unnest(range(len(found))) as i from x) join rules on f = rules.seq group by 1)
        select documents.doc_id, coalesce(n, 0) as n_known, coalesce(x.seq, '') as sentences, coalesce(licenses, '') as licenses from documents left join x using (doc_id) left join l using (doc_id)"""


def op2_warc_chunks(spark, sf_dir):
    chunks = warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    number = lambda c: F.regexp_extract(c, "([0-9-]+)", 1).try_cast("long")
    ends = chunks.filter("last")
    return ends.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def op3_source_mix(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"), ["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark, sf_dir):
    out = tokens.count_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_pretokens", "n_tokens", "log_prob")


def op5_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op6_decontamination(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.leaks(documents(spark, sf_dir).select("doc_id", "text"), items)


def op7_maxent_scores(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = maxent.held_out(F.col("doc_id"))
    return maxent.train_and_score(docs, ~held_out).withColumn("held_out", held_out)


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    languages = language.learn(docs.filter(~language.held_out(F.col("doc_id"), 5)))
    out = language.predict(docs.select("doc_id", "text"), languages)
    return out.select("row.doc_id", language.held_out(F.col("row.doc_id"), 5).alias("held_out"), "lang_pred", "score")


def op9_jaccard_join(spark, sf_dir):
    return jaccard.groups(documents(spark, sf_dir).select("doc_id", "text"))


def op10_exact_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op11_token_alignment(spark, sf_dir):
    out = alignment.align(documents(spark, sf_dir), carried=["doc_id"])
    return out.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_quality_divergence(spark, sf_dir):
    out = divergence.rules(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_phrase_collocations(spark, sf_dir):
    return phrases.collocations(documents(spark, sf_dir).select("lang", "text"))


QUERIES = {f.__name__: f for f in (op1_license_sentences, op2_warc_chunks, op3_source_mix, op4_token_counts, op5_line_dedup, op6_decontamination, op7_maxent_scores, op8_language_id, op9_jaccard_join, op10_exact_topk, op11_token_alignment, op12_quality_divergence, op13_phrase_collocations)}

def _divergence_sql() -> str:
    sizes = []
    for i, (name, pattern) in enumerate(divergence.CLASSES.items()):
        quoted = pattern.replace("'", "''")
        sizes.append((name, f"regexp_replace(t{i}, '{quoted}', '', 'g') as t{i + 1}", f"length(t{i}) - length(t{i + 1}) as n_{name}"))
    steps = ", ".join(f"s{i + 1} as (select *, {step} from s{i})" for i, (_, step, _) in enumerate(sizes))
    chars = ", ".join([f"n_{name}" for name in divergence.CLASSES if name != "space"] + [f"length(t{len(sizes)})"])
    half = lambda x, y: f"case when {x} > 0 then {x} * log2({x} / (({x} + {y}) / 2)) else 0 end"
    distance = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half('z[1]', 'z[2]')} + {half('z[2]', 'z[1]')}) / 2))))"
    return f"""
        with s0 as (select doc_id, lang as lang_of, coalesce(text, '') as t0 from documents), {steps},
        m as (select doc_id, lang_of, t0, t{len(sizes)}, {", ".join(x for _, _, x in sizes)} from s{len(sizes)}),
        d as (select doc_id, lang_of, [{chars}] as chars, n_symbol as n_symbols, list_filter(regexp_split_to_array(t0, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
              list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from m),
        e as (select *, row_number() over () as id, len(w) as n_words, list_sum(chars) as word_chars from d),
        t as (select id, lang_of, unnest(w) as word, unnest(range(len(w))) as pos from e),
        l as (select id, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as win from t window o as (partition by id order by pos)),
        r as (select id, pos from l where win is not null qualify count(*) over (partition by id, win) > 1),
        rep as (select id, count(distinct pos + k)::bigint as n_repeat_words from r, (values (0), (1), (2)) as ks(k) group by 1),
        pooled as (select lang_of as ref, word from t where lang_of is not null union all select '*', word from t),
        tot as (select ref, count(*) as total from pooled group by 1),
        often as (select ref, word, count(*) as n, any_value(total) as total from pooled join tot using (ref) group by 1, 2 having count(*) >= {divergence.COMMON} * any_value(total)),
        refs as (select tot.ref, tot.total, coalesce(list(word order by word) filter (word is not null), []) as words,
                 list_append(coalesce(list(n / often.total order by word) filter (word is not null), []), (tot.total - coalesce(sum(n), 0)) / tot.total) as word_p from tot left join often using (ref) group by 1, 2),
        ch as (select ref, list(s / whole order by i) as char_p from (select ref, i, sum(c) as s, sum(sum(c)) over (partition by ref) as whole
               from (select unnest(case when lang_of is null then ['*'] else [lang_of, '*'] end) as ref, chars from e) as z, lateral (select unnest(z.chars) as c, unnest(range(len(z.chars))) as i) group by 1, 2) group by 1),
        known as (select * from refs join ch using (ref)),
        j as (select e.*, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(a.words, b.words) as words, coalesce(a.word_p, b.word_p) as word_p, coalesce(a.char_p, b.char_p) as char_p
              from e left join rep using (id) left join known a on a.ref = lang_of and a.ref <> '*' and a.total >= {divergence.MIN_REFERENCE} left join known b on b.ref = '*'),
        f as (select *, list_transform(words, lambda x: len(list_filter(w, lambda y: y = x))) as found from j),
        v as (select *, {distance("list_transform(list_append(found, n_words - coalesce(list_sum(found), 0)), lambda x: x / n_words)", "word_p")} as far_words,
              {distance("list_transform(chars, lambda x: x / word_chars)", "char_p")} as far_chars from f)
        select doc_id, n_words, word_chars::bigint as word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (word_chars >= {divergence.MIN_CHARS} and far_chars > {divergence.MOST_CHARS}) and not (n_words >= {divergence.MIN_WORDS} and far_words > {divergence.MOST_WORDS}) as kept from v"""


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES = {
    "op1_license_sentences": _license_sql(),
    "op2_warc_chunks": f"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as s from pages),
        t as (select *, min(page_id) over (partition by html) as head from p),
        c as (select s, string_agg(substr('{_BASE32}', ((('0x' || substr(s, (k // 4) * 5 + 1, 5))::int >> (15 - 5 * (k % 4))) & 31) + 1, 1), '' order by k) as payload_digest
              from (select distinct s from p), range(0, 32) r(k) group by s)
        select page_id, strlen(html) as payload_bytes, payload_digest, case when page_id = head then 'response' else 'revisit' end as record_type,
        case when page_id <> head then head end as refers_to from t join c using (s)""",
    "op5_line_dedup": """
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
        e as (select doc_id, unnest(l) line, unnest(range(1, len(l) + 1)) pos from d),
        k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from e),
        f as (select key, max(doc_id) keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
        m as (select k.*, f.key is not null and k.doc_id < f.keeper as lost from k left join f using (key))
        select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256 from m group by doc_id""",
    "op10_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
                   where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
        select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op12_quality_divergence": _divergence_sql(),
    "op13_phrase_collocations": """
        with p as (select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
        w as (select lang, row_number() over () as piece, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from p),
        t as (select lang, piece, unnest(w) as w1, unnest(range(len(w))) as pos from w),
        l as (select lang, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3 from t window o as (partition by piece order by pos)),
        n as (select lang, count(*) as n from l group by 1),
        g as (select lang, 1 as k, w1 as phrase from l union all select lang, 2, w1 || ' ' || w2 from l where w2 is not null union all select lang, 3, w1 || ' ' || w2 || ' ' || w3 from l where w3 is not null),
        f as (select lang, k, phrase, count(*) as f from g group by all),
        c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 10),
        x as (select *, unnest(range(1, k)) as cut from c),
        s as (select x.lang, x.k, x.phrase, a, cut, p.f as l, q.f as r, (1000000::hugeint * a * a // (p.f::hugeint * q.f))::bigint as score
              from x join f p on p.lang = x.lang and p.phrase = array_to_string(w[1 : cut], ' ') join f q on q.lang = x.lang and q.phrase = array_to_string(w[cut + 1 : x.k], ' ')),
        lo as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        longer as (select lang, phrase, max(a) as longest from (select lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) as phrase from c where k = 3) group by 1, 2),
        kept as (select lo.* from lo left join longer using (lang, phrase) where longest is null or 100 * longest < 50 * a)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join n using (lang) qualify rank <= 2000""",
}
