"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from taskmill.functions.prompts import (
    BEGIN_OF_TEXT, END_HEADER, END_OF_TEXT, END_OF_TURN, START_HEADER, SYSTEM,
)
from taskmill.functions.text import WHITESPACE

SPACES = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
NEWLINE = "chr(10)"


def key(seed: int, expression: str) -> str:
    return f"cast('0x' || substr(md5('{seed}|' || {expression}), 1, 15) as bigint)"


def clean(expression: str) -> str:
    return f"trim(lower(coalesce({expression}, 'none')), {SPACES})"


def ratio(top: str, bottom: str) -> str:
    return f"case when ({bottom}) <> 0 then ({top})::double / ({bottom}) else 0.0 end"


def round_all(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


# ---- records

DOCS = """docs as (
  select d.doc_id::varchar as id, d.doc_id as original_id, d.text as input,
    case when l.quality = 1 then 'good' when l.quality = 0 then 'bad' end as output,
    d.source as dataset,
    case when l.toxic = 1 then 'News Summarization' when l.toxic = 0 then 'Quality Detection' end as task,
    d.lang, 'Judge this text from ' || d.source as instruction
  from documents d left join labels l on d.doc_id = l.doc_id)"""

ORDERS = f"""answers as (
  select o_orderkey::varchar as id, 'en' as lang, o_orderstatus as dataset, o_orderpriority as output,
    {key(7, 'o_orderkey::varchar')} % 10 as draw from orders),
orders_raw as (
  select id, lang, dataset, output,
    case when draw < 6 then ' ' || chr(160) || lower(output) || chr(10)
      when draw < 8 then '3-MEDIUM' when draw < 9 then 'junk' end as response
  from answers),
cleaned as (
  select id, lang, dataset, {clean('output')} as output, {clean('response')} as response from orders_raw)"""

FLAGS = """flags as (
  select l_orderkey::varchar as id, 'en' as lang, 'Hostility-' || max(l_linestatus) as dataset,
    string_agg(distinct l_returnflag, ',' order by l_returnflag) as output,
    coalesce(string_agg(distinct guess, ' , ' order by guess), '') as response
  from (select *, case when l_linenumber = 7 then 'junk' when l_quantity > 25 then l_returnflag end as guess
        from lineitem)
  group by l_orderkey)"""

NEIGHBOURS = """pairs as (
  select a.doc_id::varchar as id, a.lang, 'xlsum-' || a.lang as dataset, a.text as output, b.text as response
  from documents a join documents b on b.doc_id = a.doc_id + 1)"""

REPLIES = """replies as (
  select a.conv_id::varchar || '-' || a.turn::varchar as id, 'en' as lang, 'xlsum-' || a.role as dataset,
    a.text as output, b.text as response
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)"""


# ---- single-label evaluation

def repaired(source: str, seed: int = 42) -> str:
    return f"""codes as (
  select lang, dataset, output as label,
    row_number() over (partition by lang, dataset order by output) - 1 as code,
    count(*) over (partition by lang, dataset) as n_labels
  from (select distinct lang, dataset, output from {source})),
repaired as (
  select s.id, s.lang, s.dataset, s.output,
    case when k.label is not null then s.response else p.label end as response
  from {source} s
  join codes n on n.lang = s.lang and n.dataset = s.dataset and n.code = 0
  left join codes k on k.lang = s.lang and k.dataset = s.dataset and k.label = s.response
  join codes p on p.lang = s.lang and p.dataset = s.dataset and p.code = {key(seed, 's.id')} % n.n_labels)"""


REPORT = f"""report as (
  select c.lang, c.dataset, c.label, {ratio('tp', 'predicted')} as "precision",
    {ratio('tp', 'support')} as recall, {ratio('2 * tp', 'support + predicted')} as f1,
    support, predicted, tp
  from (
    select k.lang, k.dataset, k.label,
      (select count(*) from repaired r where r.lang = k.lang and r.dataset = k.dataset and r.output = k.label) as support,
      (select count(*) from repaired r where r.lang = k.lang and r.dataset = k.dataset and r.response = k.label) as predicted,
      (select count(*) from repaired r where r.lang = k.lang and r.dataset = k.dataset
        and r.output = k.label and r.response = k.label) as tp
    from codes k) c)"""

MEASURES = ["precision", "recall", "f1"]
ROUGE_KEYS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]
AVERAGED = [f"{m}_{a}" for a in ("macro", "micro", "weighted") for m in MEASURES]


def averages(group: str = "lang, dataset") -> str:
    macro = ", ".join(f'avg("{m}") as {m}_macro' for m in MEASURES)
    weighted = ", ".join(f'{ratio(f"""sum("{m}" * support)""", "sum(support)")} as {m}_weighted' for m in MEASURES)
    return f"""averages as (
  select {group}, {macro}, {weighted},
    {ratio('sum(tp)', 'sum(predicted)')} as precision_micro, {ratio('sum(tp)', 'sum(support)')} as recall_micro,
    {ratio('2 * sum(tp)', 'sum(support) + sum(predicted)')} as f1_micro,
    sum(tp)::double / sum(support) as accuracy, sum(support)::bigint as support
  from report group by {group})"""


SINGLE = f"with {ORDERS}, {repaired('cleaned')}, {REPORT}, {averages()}"


def long(source: str, names: list[str], group: str = "lang, dataset") -> str:
    return " union all ".join(
        f"select {group}, '{n}' as metric, round({n}, 6) as value from {source}" for n in names
    )


def long_quoted(source: str, names: list[str], group: str = "lang, dataset") -> str:
    return " union all ".join(
        f"""select {group}, '{n}' as metric, round("{n}", 6) as value from {source}""" for n in names
    )


# ---- multi-label evaluation

SETS = f"""sets as (
  select id, lang, dataset,
    list_distinct(list_transform(string_split({clean('output')}, ','), lambda x: trim(x, {SPACES}))) as truth,
    list_distinct(list_transform(string_split({clean('response')}, ','), lambda x: trim(x, {SPACES}))) as answer
  from flags),
classes as (select distinct * from (select lang, dataset, unnest(truth) as label from sets)),
by_dataset as (select lang, dataset, list(label) as known from classes group by all),
known as (
  select s.id, s.lang, s.dataset, s.truth, list_intersect(s.answer, b.known) as answer
  from sets s join by_dataset b on b.lang = s.lang and b.dataset = s.dataset)"""

MULTI = f"""{SETS},
items as (
  select lang, dataset, x as label, 1 as support, list_contains(answer, x)::int as predicted,
    list_contains(answer, x)::int as tp
  from (select lang, dataset, answer, unnest(truth) as x from known)
  union all
  select lang, dataset, x, 0, 1, 0
  from (select lang, dataset, truth, unnest(answer) as x from known) where not list_contains(truth, x)),
report as (
  select lang, dataset, label, {ratio('sum(tp)', 'sum(predicted)')} as "precision",
    {ratio('sum(tp)', 'sum(support)')} as recall,
    {ratio('2 * sum(tp)', 'sum(support) + sum(predicted)')} as f1,
    sum(support)::bigint as support, sum(predicted)::bigint as predicted, sum(tp)::bigint as tp
  from items group by lang, dataset, label),
row_scores as (
  select lang, dataset, {ratio('hits', 'len(answer)')} as p, {ratio('hits', 'len(truth)')} as r,
    {ratio('2 * hits', 'len(truth) + len(answer)')} as f,
    (hits = len(truth) and hits = len(answer))::int as exact
  from (select *, len(list_intersect(truth, answer)) as hits from known)),
samples as (
  select lang, dataset, avg(p) as precision_samples, avg(r) as recall_samples, avg(f) as f1_samples,
    avg(exact) as subset_accuracy
  from row_scores group by lang, dataset),
{averages()}"""


def summary_rows(rows: dict[str, str], source: str) -> str:
    parts = []
    for name, suffix in rows.items():
        columns = ", ".join(f'round({m}_{suffix}, 6) as "{m}"' for m in MEASURES)
        parts.append(
            f"select a.lang, a.dataset, 'summary' as kind, '{name}' as label, {columns}, support from {source}"
        )
    return " union all ".join(parts)


CLASS_ROWS = """select lang, dataset, 'class' as kind, label, round("precision", 6) as "precision",
  round(recall, 6) as recall, round(f1, 6) as f1, support from report"""

# ---- sampling and ordering


def sample(source: str, samples: int, within: str, by: str, columns: str) -> str:
    return f"""strata as (
  select {within}, {by} as stratum, count(*) as size from {source} group by all),
shares as (
  select *, sum(size) over (partition by {within}) as total,
    ({samples} * size) // (sum(size) over (partition by {within})) as share,
    ({samples} * size) % (sum(size) over (partition by {within})) as rest
  from strata),
takes as (
  select {within}, stratum,
    case when total <= {samples} then size else share + (
      row_number() over (partition by {within} order by rest desc, stratum nulls first)
      <= {samples} - sum(share) over (partition by {within}))::int end as take
  from shares),
ranked as (
  select *, {by} as stratum, row_number() over (partition by {within}, {by} order by {key(42, 'id')}, id) as rn
  from {source})
select {columns} from ranked r join takes t
  on {' and '.join(f'r.{w.strip()} = t.{w.strip()}' for w in within.split(','))}
  and r.stratum is not distinct from t.stratum
where rn <= take"""


FOLDER_RANK = "case folder_lang when 'l=en' then 0 when 'l=fr' then 1 when 'l=de' then 2 when 'l=es' then 3 else 4 end"
# The columns of a record as the corpus build orders them.
BUILT = ["id", "original_id", "input", "output", "task", "instruction", "native_instruction", "output_en", "folder_lang", "folder", "lang", "dataset"]
LANG_RANK = "case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 when 'es' then 3 else 4 end"


def digest(columns: list[str]) -> str:
    """The key of a whole record: lengths and texts of its columns, a dash for null."""
    return "md5(" + " || ".join(f"coalesce(length({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in columns) + ")"


def numbered(source: str, columns: list[str]) -> str:
    """Rows with the digest of their columns and the number of their copy."""
    return f"""digests as (select *, {digest(columns)} as digest from {source}),
numbered as (select *, row_number() over (partition by digest) - 1 as copy from digests)"""


WHOLE_KEY = f"""{key(42, "digest || ':' || copy::varchar")}, digest, copy"""


def order(by: str, where: str = "true") -> str:
    return f"""with {DOCS}
select id, lang, dataset, task, input,
  row_number() over (order by {by}{key(42, 'id')}, id) - 1 as position
from docs where {where}"""


# ---- prompts


def open_turn(role: str, content: str) -> str:
    return f"'{START_HEADER}{role}{END_HEADER}' || {content}"


def turn(role: str, content: str) -> str:
    return f"{open_turn(role, content)} || '{END_OF_TURN}'"


def slot(expression: str) -> str:
    return f"coalesce({expression}, 'None')"


def prompt(user: str) -> str:
    return (
        f"'{BEGIN_OF_TEXT}' || {turn('system', f"'{SYSTEM}'")} || {turn('user', user)} || "
        f"{turn('assistant', slot('output'))} || '{END_OF_TEXT}'"
    )


LABELLING = f"instruction || {NEWLINE} || 'input: ' || {slot('input')} || {NEWLINE} || 'label: '"


def summarizing(language: str) -> str:
    return f"instruction || ': ' || {slot('input')} || {NEWLINE} || 'summary in {language}: '"


TRAINING = f"""{DOCS},
training as (select *, '[' || lang || '] ' || instruction as native_instruction, upper(output) as output_en from docs)"""


def chat(instruction: str, answer: str | None, needle: str) -> str:
    prefix = f"case when contains(lower(coalesce(task, '')), '{needle}') then 'Summary: ' else 'Label: ' end"
    assistant = prefix if answer is None else f"{prefix} || {slot(answer)}"
    user = f"{slot(instruction)} || {NEWLINE} || 'Input: ' || {slot('input')}"
    return f"""with {TRAINING}
select id, 0::int as place, 'system' as role, '{SYSTEM}' as content from training
union all select id, 1::int, 'user', {user} from training
union all select id, 2::int, 'assistant', {assistant} from training"""


def chat_text(source: str, instruction: str, text: str, answer: str | None, task: str, mark: str = "summ") -> str:
    prefix = f"case when contains(lower(coalesce({task}, '')), '{mark}') then 'Summary: ' else 'Label: ' end"
    last = turn("assistant", f"{prefix} || {slot(answer)}") if answer else open_turn("assistant", prefix)
    user = f"{slot(instruction)} || {NEWLINE} || 'Input: ' || {slot(text)}"
    return (
        f"select id, '{BEGIN_OF_TEXT}' || {turn('system', f"'{SYSTEM}'")} || {turn('user', user)} || "
        f'{last} as "Text" from {source}'
    )


# ---- ROUGE


def grams(side: str, n: int) -> str:
    tokens = f"list_filter(regexp_split_to_array(lower({side}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"
    if n == 1:
        return f"(select id, unnest({tokens}) as gram from pairs)"
    return (
        f"(select id, unnest(list_transform(range(1, greatest(len(t), 1)::bigint), lambda i: t[i] || ' ' || t[i + 1])) as gram "
        f"from (select id, {tokens} as t from pairs))"
    )


def rouge(n: int) -> str:
    return f"""ref{n} as (select id, gram, count(*) as n from {grams('output', n)} group by all),
cand{n} as (select id, gram, count(*) as n from {grams('response', n)} group by all),
size{n} as (select id, sum(r) as total from (
  select id, n as r from ref{n} union all select id, n from cand{n}) group by id),
hits{n} as (select a.id, sum(least(a.n, b.n)) as hits from ref{n} a join cand{n} b on a.id = b.id and a.gram = b.gram group by a.id),
rouge{n}_rows as (
  select p.id, p.lang, p.dataset,
    case when s.total > 0 then round_even(2.0::double * coalesce(h.hits, 0)::double / s.total::double * 10000.0::double, 0) / 100 else 0.0 end as rouge{n}
  from pairs p left join size{n} s on s.id = p.id left join hits{n} h on h.id = p.id)"""


def subsequences(source: str) -> str:
    """ROUGE-L and ROUGE-Lsum of the pairs (id, output, response) in ``source``.

    The table of a pair is kept as thresholds: t[k] is the first place of the candidate up to which k tokens
    are in common, one list for each token of the reference. The way back through a table prefers to leave
    out a token of the reference. A token counts as often as it is hit, but no more than the candidate has it.
    """
    split = "list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda x: x <> '')"
    whole = {side: split.format(f"lower({side})") for side in ("output", "response")}
    line = split.format("x")
    end = 2147483647
    step = f"""list_filter(list_transform(range(1, len(t) + 2), lambda k: least(coalesce(t[k], {end}),
      coalesce(list_min(list_filter(p, lambda j: j > case when k = 1 then 0 else t[k - 1] end)), {end}))), lambda x: x < {end})"""

    def table(name: str, sides: str) -> str:
        return f"""{name}(n, i, t, ts, a, b) as (
  select n, 1, []::bigint[], [[]::bigint[]], a, b from {sides}
  union all
  select n, i + 1, t, list_append(ts, t), a, b from (
    select n, i, {step} as t, ts, a, b from (
      select n, i, t, ts, a, b, list_filter(range(1, len(b) + 1), lambda j: b[j] = a[i]) as p from {name} where i <= len(a)
    )
  )
)"""

    at = "len(list_filter(ts[{} + 1], lambda x: x <= {}))".format
    return f"""whole as (select id as n, {whole['output']} as a, {whole['response']} as b from {source}),
{table('of_whole', 'whole')},
sentences as (
  select id, row_number() over () as n, i, a, b from (
    select id, i, a, unnest(bs) as b from (
      select id, unnest(range(1, len(output) + 1)) as i, unnest(output) as a, response as bs from (
        select id, list_transform(string_split(lower(output), {NEWLINE}), lambda x: {line}) as output,
          list_transform(string_split(lower(response), {NEWLINE}), lambda x: {line}) as response from {source}
      )
    )
  ) where len(a) > 0 and len(b) > 0
),
{table('of_sentences', 'sentences')},
back(n, i, j, hit, ts, a, b) as (
  select n, len(a)::bigint, len(b)::bigint, null::bigint, ts, a, b from of_sentences where i = len(a) + 1
  union all
  select n, case when a[i] = b[j] or not aside then i - 1 else i end, case when a[i] = b[j] or aside then j - 1 else j end,
    case when a[i] = b[j] then i end, ts, a, b
  from (select *, a[i] <> b[j] and {at('i', 'j - 1')} > {at('i - 1', 'j')} as aside from back where i > 0 and j > 0)
),
hits as (
  select id, token, count(*) as n from (
    select distinct s.id, s.i as sentence, x.hit, s.a[x.hit] as token from back x join sentences s on s.n = x.n where x.hit is not null
  ) group by all
),
named as (select n as id, token, count(*) as n from (select n, unnest(b) as token from whole) group by all),
sums as (select h.id, sum(least(h.n, c.n)) as n from hits h join named c on c.id = h.id and c.token = h.token group by h.id),
longest as (select n as id, len(t) as n from of_whole where i = len(a) + 1),
sequences as (
  select p.id, p.lang, p.dataset,
    {subsequence_score('coalesce(l.n, 0)')} as "rougeL", {subsequence_score('coalesce(s.n, 0)')} as "rougeLsum"
  from {source} p join whole w on w.n = p.id left join longest l on l.id = p.id left join sums s on s.id = p.id)"""


def subsequence_score(hits: str) -> str:
    total = "(len(w.a) + len(w.b))"
    return f"case when {total} > 0 then round_even(2.0::double * {hits}::double / {total}::double * 10000.0::double, 0) / 100 else 0.0 end"


TURNS = f"{REPLIES}, pairs as (select * from replies)"
ROUGE_ALL = f"""{TURNS}, {rouge(1)}, {rouge(2)}, {subsequences('pairs')},
rouge_means as (
  select a.lang, a.dataset, avg(a.rouge1) as rouge1, avg(b.rouge2) as rouge2, avg(c."rougeL") as "rougeL", avg(c."rougeLsum") as "rougeLsum"
  from rouge1_rows a join rouge2_rows b on b.id = a.id join sequences c on c.id = a.id group by all)"""


STUB = f"""length({slot('instruction')} || {NEWLINE} || 'Input: ' || {slot('input')})::varchar || ' ' ||
  case when contains(lower(coalesce(task, '')), 'sum') then 'Summary: ' else 'Label: ' end"""


def packed(source: str, position: str, by: str = "") -> str:
    window = f"over ({f'partition by {by}' if by else ''} order by {position} rows between unbounded preceding and 1 preceding)"
    return f"""runs as (select *, coalesce(sum(n_chars) {window}, 0)::bigint as "start" from {source})
select *, "start" // 4096 as first_block,
  greatest("start", "start" + n_chars - 1) // 4096 as last_block from runs"""


SQL: dict[str, str] = {
    "single_label_metrics": f"{SINGLE} select lang, dataset, {round_all(['accuracy', *AVERAGED])} from averages",
    "class_report": f"""{SINGLE} select lang, dataset, label, round("precision", 6) as "precision",
      round(recall, 6) as recall, round(f1, 6) as f1, support from report""",
    "report_with_averages": f"""{SINGLE} {CLASS_ROWS} union all """
    + summary_rows({"accuracy": "micro", "macro avg": "macro", "weighted avg": "weighted"}, "averages a"),
    "confusion_matrix": f"""{SINGLE}
      select a.lang, a.dataset, a.label, b.label as predicted, count(r.id) as n
      from codes a join codes b on a.lang = b.lang and a.dataset = b.dataset
      left join repaired r on r.lang = a.lang and r.dataset = a.dataset and r.output = a.label and r.response = b.label
      group by all""",
    "confusion_cells": """with a as (select 'en' as lang, l_returnflag as dataset, l_partkey::varchar as label,
        case when l_linenumber = 7 then 'none' else (l_partkey + l_linenumber % 2)::varchar end as predicted from lineitem),
      c as (select lang, dataset, label, predicted, count(*) as n from a group by all)
      select *, sum(n) over (partition by lang, dataset, label)::bigint as of_label,
        sum(n) over (partition by lang, dataset, predicted)::bigint as of_predicted from c""",
    "confusion_matrix_nested": f"""{SINGLE},
      cells as (select a.lang, a.dataset, a.label, b.label as predicted, count(r.id) as n
        from codes a join codes b on a.lang = b.lang and a.dataset = b.dataset
        left join repaired r on r.lang = a.lang and r.dataset = a.dataset and r.output = a.label and r.response = b.label
        group by all),
      lines as (select lang, dataset, label, string_agg(n::varchar, ' ' order by predicted) as line from cells group by all)
      select lang, dataset, string_agg(label, '|' order by label) as labels, string_agg(line, '|' order by label) as matrix
      from lines group by all""",
    "answer_cleaning": f"with {ORDERS} select id, output, response from cleaned",
    "answer_repair": f"with {ORDERS}, {repaired('cleaned')} select id, response from repaired",
    "label_encoding": f"""with {ORDERS}, {repaired('cleaned')}
      select r.id, a.code::int as output_code, b.code::int as response_code from repaired r
      join codes a on a.lang = r.lang and a.dataset = r.dataset and a.label = r.output
      join codes b on b.lang = r.lang and b.dataset = r.dataset and b.label = r.response""",
    "distinct_labels": f"with {ORDERS} select distinct lang, dataset, output as label from orders_raw",
    "document_quality_eval": f"""with {DOCS},
      judged as (select id, lang, dataset, coalesce(output, 'none') as output,
        coalesce(lower(case when {key(5, 'id')} < {7 << 57} then upper(output) else 'bad' end), 'none') as response
        from docs),
      {repaired('judged')}, {REPORT}, {averages()},
      multi as (with {FLAGS}, {MULTI} select a.*, s.subset_accuracy from averages a
        join samples s on s.lang = a.lang and s.dataset = a.dataset),
      multi_named as (select lang, dataset, f1_micro, f1_macro, f1_weighted, subset_accuracy as accuracy from multi)
      """
    + long("averages", ["accuracy", *AVERAGED])
    + " union all "
    + long("multi_named", ["f1_micro", "f1_macro", "f1_weighted", "accuracy"]),
    "metrics_sink": f"""{SINGLE},
      multi as (with {FLAGS}, {MULTI} select a.*, s.subset_accuracy from averages a
        join samples s on s.lang = a.lang and s.dataset = a.dataset),
      both_kinds as (select dataset as experiment, accuracy, f1_micro, f1_macro, f1_weighted from averages
        union all select dataset, subset_accuracy, f1_micro, f1_macro, f1_weighted from multi)
      select experiment, {round_all(['accuracy', 'f1_micro', 'f1_macro', 'f1_weighted'])} from both_kinds""",
    "metrics_sink_documents": f"""with recursive
      ones as ({SINGLE} select * from averages),
      single_report as ({SINGLE} {CLASS_ROWS} union all """
    + summary_rows({"macro avg": "macro", "weighted avg": "weighted"}, "averages a")
    + f"""),
      matrix as ({SINGLE}
        select a.dataset, a.code as i, b.code as j, count(r.id) as n
        from codes a join codes b on a.lang = b.lang and a.dataset = b.dataset
        left join repaired r on r.lang = a.lang and r.dataset = a.dataset and r.output = a.label and r.response = b.label
        group by all),
      multi as (with {FLAGS}, {MULTI} select a.* exclude (accuracy), s.subset_accuracy as accuracy from averages a
        join samples s on s.lang = a.lang and s.dataset = a.dataset),
      multi_report as (with {FLAGS}, {MULTI} {CLASS_ROWS} union all """
    + summary_rows(
        {"micro avg": "micro", "macro avg": "macro", "weighted avg": "weighted", "samples avg": "samples"},
        "averages a join samples s on s.lang = a.lang and s.dataset = a.dataset",
    )
    + f"""),
      reports as (select * from single_report union all select * from multi_report),
      {ROUGE_ALL},
      numbers as ("""
    + long("ones", ["accuracy", *AVERAGED], "dataset")
    + " union all " + long("ones", ["accuracy"], "dataset")
    + " union all " + long("multi", ["f1_micro", "f1_macro", "f1_weighted", "accuracy"], "dataset")
    + " union all " + long_quoted("rouge_means", ROUGE_KEYS, "dataset")
    + """)
      select dataset as experiment, metric as label, '' as field, value as number from numbers
      union all select dataset, label, 'precision', "precision" from reports
      union all select dataset, label, 'recall', recall from reports
      union all select dataset, label, 'f1-score', f1 from reports
      union all select dataset, label, 'support', support::double from reports
      union all select dataset, 'row ' || i::varchar, j::varchar, n::double from matrix""",
    "label_sets": f"""with {FLAGS}, {SETS} select id, array_to_string(list_sort(truth), '|') as output,
      array_to_string(list_sort(answer), '|') as response from sets""",
    "multi_label_binarization": f"""with {FLAGS}, {SETS} select id, array_to_string(list_sort(truth), '|') as output,
      array_to_string(list_sort(answer), '|') as response from known""",
    "multi_label_metrics": f"""with {FLAGS}, {MULTI}
      select a.lang, a.dataset, {round_all(['f1_micro', 'f1_macro', 'f1_weighted'])},
        round(s.subset_accuracy, 6) as accuracy
      from averages a join samples s on s.lang = a.lang and s.dataset = a.dataset""",
    "multi_label_report": f"""with {FLAGS}, {MULTI} {CLASS_ROWS} union all """
    + summary_rows(
        {"micro avg": "micro", "macro avg": "macro", "weighted avg": "weighted", "samples avg": "samples"},
        "averages a join samples s on s.lang = a.lang and s.dataset = a.dataset",
    ),
    "stratified_sample": f"with {ORDERS}, "
    + sample("orders_raw", 1000, "lang, dataset", "output", "r.id, r.lang, r.dataset, r.output"),
    "stratified_sample_of_documents": f"with {DOCS}, "
    + sample("docs", 40, "lang", "output", "r.id, r.lang, r.dataset, r.output, r.input"),
    "uniform_sample": f"""with {DOCS}, ranked as (
      select *, row_number() over (partition by lang, dataset order by {key(42, 'id')}, id) as rn from docs)
      select id, lang, dataset, input from ranked where rn <= 5""",
    "full_sample": f"with {DOCS} select id, lang, dataset, output, input from docs",
    "corpus_sample": f"""with {DOCS}, tasked as (
      select id, lang, coalesce(task, 'untasked') as dataset, output,
        case when not contains(coalesce(task, ''), 'ummariz') then output end as part from docs), """
    + sample("tasked", 20, "lang, dataset", "part", "r.id, r.lang, r.dataset, r.output"),
    "shuffle_none": order(f"{LANG_RANK}, lang, dataset, "),
    "shuffle_fully": order(""),
    "shuffle_by_language": order(f"{LANG_RANK}, lang, "),
    "shuffle_by_task": order("task, ", "task is not null"),
    "shuffle_fully_repeated_ids": f"""with {DOCS}, several as (
        select case when original_id % 7 > 0 then (original_id % 10)::varchar end as id, lang, dataset, input,
          unnest(range(case when lang = 'de' then 3 else 1 end)) as n from docs),
      {numbered('several', ['id', 'lang', 'dataset', 'input'])}
      select id, lang, dataset, input, row_number() over (order by {WHOLE_KEY}) - 1 as position from numbered""",
    "seeded_permutation": f"""with {DOCS} select id, lang, dataset, input,
      row_number() over (partition by lang, dataset order by {key(42, 'id')}, id) - 1 as position from docs""",
    "union_missing_columns": """select doc_id::varchar as id, text as input, lang, source as dataset from documents
      union all select item_id::varchar, text, null, null from benchmark""",
    "union_languages": "select doc_id::varchar as id, lang, text as input from documents",
    "record_counts": "select lang, source as dataset, count(*) as n from documents group by all",
    "id_cast": "select doc_id::varchar as id, doc_id::varchar as original_id from documents",
    "prompt_classification": f"with {DOCS} select id, {prompt(LABELLING)} as text from docs",
    "prompt_summarization": f"""with {DOCS} select id, case
      when contains(coalesce(task, ''), 'Summarization') and lang = 'en' then {prompt(summarizing('English'))}
      when contains(coalesce(task, ''), 'Summarization') and lang = 'es' then {prompt(summarizing('Hindi'))}
      else {prompt(LABELLING)} end as text from docs""",
    "prompt_defaults": f"""with {DOCS} select id, 'en' as lang, '' as dataset, '' as task,
      {prompt(LABELLING)} as text from docs""",
    "summarization_rules": f"""with {DOCS}, named as (select task, coalesce(task, '') as t, dataset from docs)
      select task, contains(t, 'Summarization') or contains(dataset, 'Summarization') as render,
        contains(t, 'ummariz') as sample, contains(lower(t), 'summ') as train, contains(lower(t), 'sum') as score,
        count(*) as n from named group by all""",
    "metric_routing": f"""with {ORDERS}, {FLAGS}, {REPLIES},
      everything as (select dataset from orders_raw union all select dataset from flags union all select dataset from replies)
      select dataset, case when contains(dataset, 'Hostility') then 'multi_label'
        when contains(dataset, 'xlsum') then 'rouge' else 'single_label' end as kind, count(*) as n
      from everything group by all""",
    "chat_native": chat("native_instruction", "output", "summ"),
    "chat_english": chat("instruction", "output_en", "summ"),
    "chat_scoring": chat("instruction", None, "sum"),
    "chat_text": f"with {TRAINING} " + chat_text("training", "native_instruction", "input", "output", "task"),
    "chat_text_open": f"with {DOCS} " + chat_text("docs", "instruction", "input", None, "task", "sum"),
    "chat_text_of_turns": f"with {REPLIES} " + chat_text("replies", "'Reply'", "output", "response", "'Dialogue'"),
    "label_translation": """select c_custkey::varchar as id, c_mktsegment as output,
      case when c_mktsegment = 'MACHINERY' then c_mktsegment else lower(c_mktsegment) end as output_en from customer""",
    "instruction_assignment": f"""with {DOCS}, bank as (
      select 'src' || (item_id % 20)::varchar as dataset, item_id // 20 as variant, text as instruction from benchmark),
      sizes as (select dataset, count(*) as n from bank group by all)
      select d.id, d.dataset, b.instruction from docs d left join sizes s on s.dataset = d.dataset
      left join bank b on b.dataset = d.dataset and b.variant = {key(42, 'd.id')} % s.n""",
    "registry_enrichment": f"""with {DOCS}, registry as (
      select dataset, lang, coalesce(string_agg(distinct output, '|' order by output), '') as labels from docs group by all)
      select d.id, d.dataset, d.lang, 'Task of ' || d.dataset as task, 'Defined for ' || d.lang as task_definition,
        r.labels from docs d join registry r on r.dataset = d.dataset and r.lang = d.lang""",
    "registry_parse": """select c_name as dataset, c_mktsegment as task, 'A task.' as task_definition,
      unnest(case when c_nationkey < 10 then ['hi', 'en'] when c_nationkey < 20 then ['ar'] else ['French'] end) as lang,
      case when c_nationkey % 5 <> 0 then c_mktsegment || '|other' end as labels from customer""",
    "registry_source": """select c_name as dataset, 'ar' as lang, unnest([c_mktsegment, 'other']) as label from customer""",
    "label_map_parse": "select p_name as native, p_type as english, count(*) as n from part group by all",
    "instruction_bank_parse": """select dataset, variant, instruction, count(*) as n from (
      select p_brand as dataset, unnest([0, 1, 2])::int as variant,
        unnest([p_name, p_type, p_name || ' ' || p_type]) as instruction from part) group by all""",
    "pending_rows": f"with {DOCS} select id, lang, dataset from docs where output is null",
    "first_of_duplicates": """select 'en' as lang, o_orderstatus as dataset, o_custkey::varchar as id,
      min(o_orderkey) as o_orderkey from orders group by all""",
    "batch_scoring": f"with {DOCS} select id, lang, dataset, {STUB} as response from docs",
    "stream_scoring_batches": f"with {DOCS} select id, lang, dataset, {STUB} as response from docs",
    "stream_scoring": f"with {DOCS} select id, lang, dataset, {STUB} as response from docs",
    "batch_map": "select doc_id, length(text)::varchar || ' chars' as size from documents",
    "rouge1": f"with {NEIGHBOURS}, {rouge(1)} select id, rouge1 from rouge1_rows",
    "rouge2": f"with {NEIGHBOURS}, {rouge(2)} select id, rouge2 from rouge2_rows",
    "rouge_mean": f"""with {NEIGHBOURS}, {rouge(1)}, {rouge(2)}
      select a.lang, a.dataset, round(avg(a.rouge1), 6) as rouge1, round(avg(b.rouge2), 6) as rouge2
      from rouge1_rows a join rouge2_rows b on b.id = a.id group by all""",
    "rouge_l": f"""with recursive {NEIGHBOURS}, {subsequences('pairs')} select id, "rougeL" from sequences""",
    "rouge_lsum": f"""with recursive {NEIGHBOURS}, {subsequences('pairs')} select id, "rougeLsum" from sequences""",
    "rouge_all": f"""with recursive {ROUGE_ALL}
      select lang, dataset, {', '.join(f'round("{k}", 6) as "{k}"' for k in ROUGE_KEYS)} from rouge_means""",
    "experiment_evaluation": f"""with recursive
      ones as ({SINGLE} select * from averages),
      multi as (with {FLAGS}, {MULTI} select a.*, s.subset_accuracy from averages a
        join samples s on s.lang = a.lang and s.dataset = a.dataset),
      multi_named as (select lang, dataset, f1_micro, f1_macro, f1_weighted, subset_accuracy as accuracy from multi),
      {ROUGE_ALL}
      """
    + long("ones", ["accuracy", *AVERAGED])
    + " union all "
    + long("multi_named", ["f1_micro", "f1_macro", "f1_weighted", "accuracy"])
    + " union all "
    + long_quoted("rouge_means", ROUGE_KEYS),
    "pack_blocks": "with rows_in as (select lang, doc_id as position, n_chars from documents), "
    + packed("rows_in", "position", "lang"),
    "pack_shuffled": f"""with {DOCS}, rows_in as (select id, length(input)::int as n_chars,
      row_number() over (order by {key(42, 'id')}, id) - 1 as position from docs), """
    + packed("rows_in", "position"),
    "corpus_roundtrip": f"""with {DOCS}, sampled as ("""
    f"select * from (with {DOCS}, parted as (select *, case when not contains(coalesce(task, ''), 'ummariz') then output end as part from docs), "
    + sample("parted", 10, "lang, dataset", "part", "r.* exclude (stratum, rn, part)")
    + f""")) select id, original_id::varchar as original_id, lang, dataset,
      row_number() over (order by {LANG_RANK}, lang, {key(42, 'id')}, id) - 1 as position,
      case when contains(coalesce(task, ''), 'Summarization') and lang = 'en' then {prompt(summarizing('English'))}
        else {prompt(LABELLING)} end as text from sampled""",
    "corpus_source": f"""with {DOCS} select id, input, output, 'd=' || dataset as folder, 'l=' || lang as folder_lang
      from docs where output is not null""",
    "record_source": f"""with {DOCS} select id, original_id::varchar as original_id, input, output, dataset, task, lang,
      instruction from docs""",
    "corpus_source_array": f"""with {DOCS} select id, input, instruction, 'd=' || dataset as folder, 'l=' || lang as folder_lang
      from docs where output is null""",
    "record_source_array": f"""with {DOCS} select id, original_id::varchar as original_id, input, output, dataset, task, lang,
      instruction from docs""",
    "first_of_files": f"""with {DOCS}, files as (
        select *, 'b-large' as file from docs
        union all select *, 'c-middle' from docs where original_id % 3 > 0
        union all select *, 'a-small' from docs where original_id % 10 = 0)
      select (original_id % 500)::varchar || '-' || lang as id, lang, dataset, min(file) as file from files group by all""",
    "corpus_build": f"""with {DOCS}, tagged as (
        select id, original_id::varchar as original_id, input, output, '' as dataset, task, 'en' as lang, instruction,
          null::varchar as native_instruction, null::varchar as output_en, 'l=' || lang as folder_lang, 'd=' || dataset as folder
        from docs),
      sampled as (select * from (with parted as (
        select *, case when not contains(coalesce(task, ''), 'ummariz') then output end as part from tagged), """
    + sample("parted", 10, "folder_lang, folder", "part", "r.* exclude (stratum, rn, part)")
    + f""")),
      {numbered('sampled', BUILT)}
      select id, folder_lang, folder, lang, dataset, row_number() over (order by {FOLDER_RANK}, folder_lang, {WHOLE_KEY}) - 1 as position,
        case when contains(coalesce(task, ''), 'Summarization') then {prompt(summarizing('English'))} else {prompt(LABELLING)} end as text
      from numbered""",
    "result_source_objects": f"""with {DOCS} select id, upper(output) as response,
      case when output is null then 'corrupt' else 'good' end as state from docs where original_id % 10 = 0""",
    "response_sink": f"""with {DOCS} select id, original_id::varchar as original_id, input, output, dataset, task, lang,
      instruction, 'Ünï ' || id as response from docs""",
    "result_source": f"""with {DOCS} select 'folder=' || dataset as experiment, count(*) as n, count(output) as answered,
      0::bigint as corrupt from docs group by all""",
    "corrupt_quarantine": """select 'experiment=' || d.source as experiment,
      case when l.doc_id is null then 'corrupt' else 'good' end as state, count(*) as n
      from documents d left join labels l on d.doc_id = l.doc_id group by all""",
}
