"""Registered queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import EMOJI, MEDIA, MEDIA_HINTS, STRETCHED, WORD
from ..functions.words import DICTIONARY, NEGATIVE, POSITIVE, SLANG, STOPWORDS
from ..operators import claims, conversations, extract, lexical, recent, search, verdicts, volume
from ..sources import decode, packs
from ..sources.driver_tables import CLAIMS_SQL, CONVERSATIONS_SQL, EVENTS_SQL, messages_from_conversations, messages_from_events, messages_with_claims

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None, base: str = EVENTS_SQL, more: str = "") -> None:
    source = {EVENTS_SQL: messages_from_events, CONVERSATIONS_SQL: messages_from_conversations, CLAIMS_SQL: messages_with_claims}[base]
    QUERIES[name] = lambda spark, d: query(source(spark, d))
    QUERIES[name].__name__ = name
    if sql:
        ORACLE_SQL[name] = f"WITH {base}{', ' + more if more else ''}\n{sql}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ratio(num: str, den: str, digits: int) -> str:
    """As functions.text.ratio."""
    scaled, both = f"(2 * CAST({num} AS HUGEINT) * {10**digits} + ({den}))", f"nullif(2 * CAST({den} AS HUGEINT), 0)"
    return f"coalesce(CAST({scaled} // {both} - CASE WHEN {scaled} % {both} = 0 AND ({scaled} // {both}) % 2 = 1 THEN 1 ELSE 0 END AS DOUBLE) / {10**digits}, 0.0)"


def _list(words) -> str:
    return ", ".join(map(_q, words))


_MEDIA = f"(regexp_matches(text, '{'|'.join(h for x in MEDIA_HINTS for h in (x, x.upper()))}') AND regexp_matches(lower(text), {_q('|'.join(MEDIA))}))"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', ' ', 'g'), 'www\.\S+', ' ', 'g'), '[@#]\w+', ' ', 'g')"
_LATIN = f"list_transform(regexp_extract_all(text, {_q(WORD)}), lambda x: replace(x, '’', ''''))"
_WORDS = _LATIN.replace("(text,", f"({_CLEAN},")
_S, _R = "count_if(direction = 'sent')", "count_if(direction = 'received')"

# volume
_add("overview", volume.overview, f"SELECT *, {_ratio('total', 'days', 2)} AS per_day FROM (SELECT count(*) AS total, {_S} AS sent, {_R} AS received, count(DISTINCT contact) AS contacts, min(ts) AS first, max(ts) AS last, coalesce(date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1, 0) AS days FROM msgs)")
_CONTACTS = f"""per AS (SELECT contact, count(*) AS total, {_S} AS sent, {_R} AS received, coalesce(sum(n) FILTER (direction = 'sent'), 0) AS ws, count(n) FILTER (direction = 'sent') AS ns,
  coalesce(sum(n) FILTER (direction = 'received'), 0) AS wr, count(n) FILTER (direction = 'received') AS nr, min(ts) AS first, max(ts) AS last, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS active_days,
  count(DISTINCT sender) FILTER (direction = 'received') > 1 AS is_group FROM (SELECT *, CASE WHEN NOT {_MEDIA} THEN len({_WORDS}) END AS n FROM msgs) GROUP BY contact)"""
_add("contact_frequency", volume.contact_frequency, f"SELECT contact, total, sent, received, {_ratio('sent', 'total', 3)} AS sent_share, {_ratio('ws', 'ns', 1)} AS avg_words_sent, {_ratio('wr', 'nr', 1)} AS avg_words_received, first, last, active_days, {_ratio('total', 'active_days', 2)} AS per_day, is_group FROM per", more=_CONTACTS)
_add("contact_members", volume.contact_members, "SELECT contact, sender, count(*) AS n FROM msgs WHERE direction = 'received' GROUP BY ALL")
_add("longest_writers", search.longest_writers, f"SELECT contact, {_ratio('wr', 'nr', 1)} AS avg_words_received FROM per ORDER BY 2 DESC, 1 LIMIT 12", more=_CONTACTS)
for _name, _f, _n, _e in (("by_hour", volume.by_hour, 24, "hour(ts)"), ("by_weekday", volume.by_weekday, 7, "isodow(ts) - 1")):
    _c = _name[3:]
    _add(_name, _f, f"SELECT r.{_c}, coalesce(sent, 0) AS sent, coalesce(received, 0) AS received FROM (SELECT unnest(range({_n})) AS {_c}) r LEFT JOIN (SELECT {_e} AS {_c}, {_S} AS sent, {_R} AS received FROM msgs GROUP BY 1) USING ({_c})")
_add("heatmap", volume.heatmap, "SELECT w.weekday, h.hour, (SELECT count(*) FROM msgs WHERE isodow(ts) - 1 = w.weekday AND hour(ts) = h.hour) AS n FROM (SELECT unnest(range(7)) AS weekday) w, (SELECT unnest(range(24)) AS hour) h")
_add("by_month", volume.by_month, f"SELECT year(ts) AS year, month(ts) AS month, {_S} AS sent, {_R} AS received FROM msgs GROUP BY ALL")
_add("busiest_day", volume.busiest_day, "SELECT ts::DATE AS day, count(*) AS n FROM msgs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
_PEAK = lambda e, by="": f"(SELECT {by}p FROM (SELECT {by}{e} AS p, count(*) AS n FROM msgs GROUP BY ALL) ORDER BY n DESC, p LIMIT 1)"
_add("peak_hour_weekday", volume.peaks, f"SELECT {_PEAK('hour(ts)')} AS peak_hour, {_PEAK('isodow(ts) - 1')} AS peak_weekday")
_RANKED = lambda e, name: f"{name} AS (SELECT contact, p AS {name}, t FROM (SELECT contact, {e} AS p, sum(count(*)) OVER (PARTITION BY contact) AS t, row_number() OVER (PARTITION BY contact ORDER BY count(*) DESC, {e}) AS r FROM msgs GROUP BY contact, {e}) WHERE r = 1)"
_add("contact_peaks", volume.contact_peaks, "SELECT contact, CAST(h.t AS BIGINT) AS total, peak_hour, peak_weekday FROM peak_hour h JOIN peak_weekday USING (contact) ORDER BY 2 DESC, 1 LIMIT 20", more=f"{_RANKED('hour(ts)', 'peak_hour')}, {_RANKED('isodow(ts) - 1', 'peak_weekday')}")
_add("contact_hour_profile", volume.hour_profile, "SELECT contact, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY h) AS profile FROM (SELECT DISTINCT contact FROM msgs) CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN (SELECT contact, hour(ts) AS h, count(*) AS n FROM msgs GROUP BY ALL) USING (contact, h) GROUP BY contact")
_STREAK = "streak AS (SELECT count(*) AS days, min(d) AS start, max(d) AS \"end\" FROM (SELECT d, d - CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS i FROM (SELECT DISTINCT ts::DATE AS d FROM msgs)) GROUP BY i ORDER BY 1 DESC, 2 LIMIT 1)"
_add("longest_streak", volume.longest_streak, 'SELECT days, start, "end" FROM streak', more=_STREAK)
_add("years", volume.years, "SELECT DISTINCT year(ts) AS year FROM msgs")
_add("night_share", volume.night_share, f"SELECT n AS night_messages, {_ratio('n', 't', 3)} AS night_share FROM (SELECT count_if(hour(ts) < 5) AS n, count(*) AS t FROM msgs)")
_add("group_members", lambda m: volume.group_members(m, "user_1"), f"""SELECT sender, k AS count, {_ratio('k', '(SELECT count(*) FROM own)', 3)} AS share, {_ratio('w', 'c', 1)} AS avg_words,
  (SELECT h FROM (SELECT hour(ts) AS h, count(*) AS n, min(row(ts, msg_id)) AS f FROM own o WHERE o.sender = g.sender GROUP BY 1) ORDER BY n DESC, f LIMIT 1) AS peak_hour, first, last, is_you
  FROM (SELECT sender, count(*) AS k, coalesce(sum(n), 0) AS w, count(n) AS c, min(ts) AS first, max(ts) AS last, arg_min(direction, row(ts, msg_id)) = 'sent' AS is_you FROM own GROUP BY sender) g""", more=f"own AS (SELECT *, CASE WHEN NOT {_MEDIA} THEN len({_WORDS}) END AS n FROM msgs WHERE contact = 'user_1')")

# conversations
_ADJ = """a0 AS (SELECT *, lag(ts) OVER w AS prev_ts, lag(direction) OVER w AS prev_dir FROM msgs WINDOW w AS (PARTITION BY contact ORDER BY ts, msg_id)),
a1 AS (SELECT *, epoch_us(ts) - epoch_us(prev_ts) AS gap FROM a0), a2 AS (SELECT *, CASE WHEN gap IS NULL OR gap > 21600000000 THEN 1 ELSE 0 END AS new_conv FROM a1),
adj AS (SELECT *, sum(new_conv) OVER w AS conv_no, sum(CASE WHEN new_conv = 1 OR direction <> prev_dir THEN 1 ELSE 0 END) OVER w AS run_no, direction <> prev_dir AND gap <= 43200000000 AS reply FROM a2 WINDOW w AS (PARTITION BY contact ORDER BY ts, msg_id)),
conv AS (SELECT contact, CAST(conv_no AS BIGINT) AS conv_no, count(*) AS n, min(ts) AS start, max(ts) AS "end", arg_min(direction, row(ts, msg_id)) AS opened, arg_max(direction, row(ts, msg_id)) AS closed FROM adj GROUP BY ALL),
runs AS (SELECT contact, CAST(conv_no AS BIGINT) AS conv_no, CAST(run_no AS BIGINT) AS run_no, min(direction) AS direction, count(*) AS n FROM adj GROUP BY contact, conv_no, run_no)"""
_REPLY = "median(gap) FILTER (reply AND direction = 'sent') AS you_micros, median(gap) FILTER (reply AND direction = 'received') AS them_micros, count(gap) FILTER (reply AND direction = 'sent') AS you_n, count(gap) FILTER (reply AND direction = 'received') AS them_n"
_HEALTH = f"""{_ADJ}, health AS (SELECT contact, conversations, you_opened, {_ratio('you_opened', 'conversations', 3)} AS you_opened_share, you_closed, {_ratio('you_closed', 'conversations', 3)} AS you_closed_share, your_double_texts, their_double_texts,
  {_ratio('messages', 'conversations', 1)} AS avg_length, {_ratio('silence', '86400000000', 1)} AS longest_silence_days, you_micros, them_micros, you_n, them_n
  FROM (SELECT contact, count(*) AS conversations, sum(n) AS messages, count_if(opened = 'sent') AS you_opened, count_if(closed = 'sent') AS you_closed FROM conv GROUP BY 1)
  JOIN (SELECT contact, count_if(direction = 'sent' AND n >= 2) AS your_double_texts, count_if(direction = 'received' AND n >= 2) AS their_double_texts FROM runs GROUP BY 1) USING (contact)
  JOIN (SELECT contact, coalesce(max(gap), 0) AS silence, {_REPLY} FROM adj GROUP BY 1) USING (contact))"""
_adj = conversations.adjacency
_health = lambda m: conversations.conversation_health(_adj(m))
_add("reply_latency", lambda m: conversations.reply_latency(_adj(m)), f"SELECT {_REPLY} FROM adj", more=_ADJ)
_add("reply_latency_by_contact", lambda m: conversations.reply_latency_by_contact(_adj(m)), f"SELECT contact, {_REPLY} FROM adj GROUP BY contact", more=_ADJ)
_add("conversations_split", lambda m: conversations.split_conversations(_adj(m)), "SELECT * FROM conv", more=_ADJ)
_add("conversation_runs", lambda m: conversations.runs(_adj(m)), "SELECT * FROM runs", more=_ADJ)
_add("conversation_health", _health, "SELECT * FROM health", more=_HEALTH)
_SUMMARY = "summary AS (SELECT CAST(sum(conversations) AS BIGINT) AS conversations, CAST(sum(you_opened) AS BIGINT) AS you_opened, CAST(sum(your_double_texts) AS BIGINT) AS double_texts, median(you_micros) AS you_micros, median(them_micros) AS them_micros, (SELECT contact FROM health WHERE conversations >= 5 ORDER BY you_closed_share DESC, conversations DESC, contact DESC LIMIT 1) AS ghosted_by FROM health)"
_add("conversation_summary", lambda m: conversations.conversation_summary(_health(m)), "SELECT * FROM summary", more=f"{_HEALTH}, {_SUMMARY}")
_add("double_texts", lambda m: _health(m).select("contact", "your_double_texts", "their_double_texts"), "SELECT contact, your_double_texts, their_double_texts FROM health", more=_HEALTH)
_add("longest_silence", lambda m: _health(m).select("contact", "longest_silence_days"), "SELECT contact, longest_silence_days FROM health", more=_HEALTH)

# words, emoji, tone, spelling
_TOK = f"tok AS (SELECT *, lower(word) AS lw FROM (SELECT msg_id, contact, sender, direction, ts, unnest({_WORDS}) AS word FROM msgs WHERE NOT {_MEDIA}))"
_FREQ = f"SELECT lw AS word, count(*) AS count FROM tok WHERE length(lw) >= 3 AND lw NOT IN ({_list(STOPWORDS)})"
_add("word_frequency", lexical.word_frequency, f"{_FREQ} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", more=_TOK)
_add("word_frequency_sent", lambda m: lexical.word_frequency(m, "sent"), f"{_FREQ} AND direction = 'sent' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", more=_TOK)
_add("word_frequency_conversations", lambda m: lexical.word_frequency(m, limit=None), f"{_FREQ} GROUP BY 1", base=CONVERSATIONS_SQL, more=_TOK)
_SENT = r"unnest(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))"
_add("sentence_token_counts", lexical.sentence_tokens, f"SELECT msg_id, s.i - 1 AS sentence_no, len({_WORDS.replace('(text,', '(s.x,')}) AS words FROM (SELECT msg_id, unnest(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x, i: {{'x': x, 'i': i}})) AS s FROM msgs) WHERE len({_WORDS.replace('(text,', '(s.x,')}) > 0")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_NOISE = f"(length(lw) < 3 OR lw IN ({_list(SLANG)}) OR regexp_matches(lw, '^({'|'.join(c * 3 + '+' for c in _LETTERS)}|''''''+)$|{'|'.join(STRETCHED)}') OR NOT regexp_matches(lw, '^[a-z'']+$'))"
_add("noise_words", lexical.noise_words, f"SELECT lw, count(*) AS count FROM tok WHERE {_NOISE} GROUP BY 1", more=_TOK)
_SPELL = f"""s0 AS (SELECT msg_id, contact, sender, ts, text, upper(text) = text AND lower(text) <> text AS loud, unnest(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x, i: {{'x': x, 'i': i}})) AS s FROM msgs WHERE direction = 'sent' AND NOT {_MEDIA}),
s1 AS (SELECT msg_id, contact, sender, ts, text, loud, s.i AS s_no, unnest(list_transform({_WORDS.replace('(text,', '(s.x,')}, lambda x, i: {{'w': x, 'i': i}})) AS t FROM s0), s2 AS (SELECT *, t.w AS word, lower(t.w) AS lw, t.i AS pos FROM s1),
bad AS (SELECT * FROM s2 WHERE NOT {_NOISE} AND NOT (pos > 1 AND regexp_matches(word, '^[A-Z]') AND NOT loud) AND lw NOT IN ({_list([*DICTIONARY, *SLANG])}) AND regexp_replace(lw, '''s$', '') NOT IN ({_list([*DICTIONARY, *SLANG])}))"""
_add("misspellings_totals", lexical.misspellings_totals, f"SELECT c AS words_checked, b AS misspelled_total, u AS unique_words, {_ratio('1000 * b', 'c', 2)} AS rate FROM (SELECT (SELECT count(*) FROM s2) AS c, (SELECT count(*) FROM bad) AS b, (SELECT count(DISTINCT lw) FROM bad) AS u)", more=_SPELL)
_add("misspellings_words", lexical.misspellings_words, f"""SELECT word, count, coalesce(near, CASE WHEN near IS NULL AND length(word) <= 12 AND count_if(near IS NULL AND length(word) <= 12) OVER (ORDER BY count DESC, word ROWS UNBOUNDED PRECEDING) <= 3 THEN (SELECT min(d) FROM (SELECT unnest([{_list(sorted(set(DICTIONARY)))}]) AS d) WHERE damerau_levenshtein(word, d) <= 2) END) AS suggestion, example FROM (SELECT word, count, (SELECT min(d) FROM (SELECT unnest([{_list(sorted(set(DICTIONARY)))}]) AS d) WHERE damerau_levenshtein(word, d) <= 1) AS near, example
  FROM (SELECT lw AS word, count(*) AS count, arg_min(left(text, 140), row(ts, msg_id, s_no, pos)) AS example FROM bad GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50))""", more=_SPELL)
for _k in ("contact", "sender"):
    _add(f"misspellings_by_{_k}", lambda m, k=_k: lexical.misspellings_by(m, k), f"SELECT {_k}, CAST(sum(n) AS BIGINT) AS count, string_agg(lw, ',' ORDER BY r) FILTER (r <= 5) AS top_words FROM (SELECT {_k}, lw, count(*) AS n, row_number() OVER (PARTITION BY {_k} ORDER BY count(*) DESC, lw) AS r FROM bad GROUP BY {_k}, lw) GROUP BY 1", more=_SPELL)
_EMO = f"emo AS (SELECT msg_id, contact, direction, unnest(regexp_extract_all(text, {_q(EMOJI)})) AS emoji FROM msgs)"
_add("emoji_totals", lexical.emoji_totals, f"SELECT t AS total, u AS unique_emoji, c AS carriers, {_ratio('c', 'n', 3)} AS share FROM (SELECT (SELECT count(*) FROM emo) AS t, (SELECT count(DISTINCT emoji) FROM emo) AS u, (SELECT count(DISTINCT msg_id) FROM emo) AS c, (SELECT count(*) FROM msgs) AS n)", more=_EMO)
_add("emoji_top", lexical.emoji_top, f"SELECT emoji, count(*) AS count, {_S} AS sent, {_R} AS received FROM emo GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30", more=_EMO)
_add("emoji_by_contact", lexical.emoji_by_contact, "SELECT contact, CAST(sum(n) AS BIGINT) AS count, string_agg(emoji, ' ' ORDER BY r) FILTER (r <= 5) AS top_emoji FROM (SELECT contact, emoji, count(*) AS n, row_number() OVER (PARTITION BY contact ORDER BY count(*) DESC, emoji) AS r FROM emo GROUP BY contact, emoji) GROUP BY 1", more=_EMO)
_TONED = f"{_TOK}, toned AS (SELECT *, year(ts) AS year, month(ts) AS month, CASE WHEN lw IN ({_list(POSITIVE)}) THEN 1 ELSE -1 END AS polarity FROM tok WHERE lw IN ({_list([*POSITIVE, *NEGATIVE])}))"
_NET = "count_if(polarity > 0) AS positive, count_if(polarity < 0) AS negative, round_even(coalesce(CAST(count_if(polarity > 0) - count_if(polarity < 0) AS DOUBLE) / nullif(count(*), 0), 0.0), 3) AS net"
_add("tone_totals", lexical.tone, f"SELECT {_NET} FROM toned", more=_TONED)
_add("tone_by_month", lambda m: lexical.tone(m, "year", "month"), f"SELECT year, month, {_NET} FROM toned GROUP BY year, month", more=_TONED)
_add("tone_by_contact", lambda m: lexical.tone(m, "contact"), f"SELECT contact, {_NET} FROM toned GROUP BY contact", more=_TONED)
_add("tone_top_words", lexical.tone_words, "SELECT CAST(polarity AS BIGINT) AS polarity, lw AS word, n AS count FROM (SELECT polarity, lw, count(*) AS n, row_number() OVER (PARTITION BY polarity ORDER BY count(*) DESC, lw) AS r FROM toned GROUP BY 1, 2) WHERE r <= 15", more=_TONED)

# search
_HIT = "SELECT msg_id, contact, sender, direction, ts, text, source FROM msgs WHERE"
_add("search_contact_hour", lambda m: search.search(m, contact="user_7", hour=9, limit=None), f"{_HIT} contact = 'user_7' AND hour(ts) = 9")
_add("search_month_page", lambda m: search.search(m, month="2024-01", direction="sent", limit=50, offset=20), f"{_HIT} direction = 'sent' AND ts >= '2024-01-01' AND ts < '2024-02-01' ORDER BY ts DESC, msg_id LIMIT 50 OFFSET 20")
_add("search_substring", lambda m: search.search(m, q="TH", limit=None), f"{_HIT} contains(lower(text), 'th')")
_add("search_whole_word", lambda m: search.search(m, word="can't", limit=None), f"{_HIT} regexp_matches(lower(text), '(^|[^a-z''’])can[''’]t($|[^a-z''’])')")
_add("search_conversations", lambda m: search.search(m, q="the", weekday=0, limit=None), f"{_HIT} contains(lower(text), 'the') AND isodow(ts) = 1", base=CONVERSATIONS_SQL)

# ingest
_TWICE = "twice AS (SELECT * FROM msgs UNION ALL SELECT msg_id + 1000000000, contact, sender, direction, ts, text, source FROM msgs WHERE msg_id % 3 = 0)"
_twice = lambda m: m.union(m.where("msg_id % 3 = 0").withColumn("msg_id", F.col("msg_id") + 1_000_000_000))
_ID = "contact, direction, ts, text, CASE WHEN direction = 'received' THEN sender ELSE '' END"
_add("identity_dedupe", lambda m: search.identity_dedupe(_twice(m)), f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY msg_id) AS r FROM twice) WHERE r = 1", more=_TWICE)
_add("append_anti_join", lambda m: search.new_messages(m.where("msg_id % 2 = 0"), _twice(m)), f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {_ID} ORDER BY msg_id) AS r FROM twice) t WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM msgs m WHERE m.msg_id % 2 = 0 AND m.contact = t.contact AND m.direction = t.direction AND m.ts = t.ts AND m.text = t.text AND (t.direction = 'sent' OR m.sender = t.sender))", more=_TWICE)
_add("import_report", lambda m: search.import_report(_twice(m), search.identity_dedupe(_twice(m)), "csv"), f"SELECT 'csv' AS format, (SELECT count(*) FROM twice) AS parsed, (SELECT count(*) FROM (SELECT DISTINCT {_ID} FROM twice)) AS added, (SELECT count(DISTINCT contact) FROM msgs) AS contacts, '' AS note", more=_TWICE)
_add("distinct_contacts", search.distinct_contacts, "SELECT DISTINCT contact FROM msgs")
_add("status", search.status, "SELECT count(*) AS messages, count(DISTINCT contact) AS contacts FROM msgs")
_add("dashboard_overview", search.dashboard_overview, f"SELECT (SELECT count(*) FROM msgs) AS total, (SELECT count(DISTINCT contact) FROM msgs) AS contacts, (SELECT date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 FROM msgs) AS days, t.contact AS top_contact, t.total AS top_total, {_PEAK('hour(ts)')} AS peak_hour, {_PEAK('isodow(ts) - 1')} AS peak_weekday, conversations, double_texts, ghosted_by FROM summary, (SELECT contact, total FROM per ORDER BY total DESC, first, contact LIMIT 1) t", more=f"{_HEALTH}, {_SUMMARY}, {_CONTACTS}")
_add("wrapped_card", lambda m: search.wrapped(m, 2024).select("year", "empty", "total", "sent", "received", "sent_share", "people", "top_contact", "runner_up", "words_written", "peak_hour", "peak_weekday", "busiest_day", "busiest_count", "night_messages", "you_micros", "them_micros", "conversations", "streak_days", "streak_start", "top_word", "top_emoji", "top_typo", "typo_rate", "net"), f"""SELECT 2024 AS year, false AS empty, total, sent, received, sent_share, people, p[1] AS top_contact, p[2] AS runner_up, words_written, {_PEAK('hour(ts)')} AS peak_hour, {_PEAK('isodow(ts) - 1')} AS peak_weekday, busiest_day, busiest_count, night_messages, r.you_micros, r.them_micros, conversations, days AS streak_days, start AS streak_start,
  ({_FREQ.replace('AS word, count(*) AS count', '')} AND direction = 'sent' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_word, (SELECT emoji FROM emo GROUP BY 1 ORDER BY count_if(direction = 'sent') DESC, CASE WHEN count_if(direction = 'sent') = 0 THEN -count(*) END, 1 LIMIT 1) AS top_emoji, (SELECT lw FROM bad GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_typo, {_ratio('1000 * (SELECT count(*) FROM bad)', '(SELECT count(*) FROM s2)', 2)} AS typo_rate, (SELECT net FROM (SELECT {_NET} FROM toned)) AS net
  FROM (SELECT count(*) AS total, {_S} AS sent, {_R} AS received, {_ratio(_S, 'count(*)', 3)} AS sent_share, count(DISTINCT contact) AS people, count_if(hour(ts) < 5) AS night_messages FROM msgs), (SELECT list(contact ORDER BY total DESC, first, contact) AS p FROM per), (SELECT CAST(sum(len({_WORDS})) AS BIGINT) AS words_written FROM msgs WHERE direction = 'sent' AND NOT {_MEDIA}),
  (SELECT ts::DATE AS busiest_day, count(*) AS busiest_count FROM msgs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), (SELECT {_REPLY} FROM adj) r, summary s, streak""", more=f"{_HEALTH}, {_SUMMARY}, {_CONTACTS}, {_STREAK}, {_TOK}, {_TONED.split(', toned', 1)[0] and 'toned' + _TONED.split(', toned', 1)[1]}, {_EMO}, {_SPELL}")
_add("wrapped_empty_year", lambda m: search.wrapped(m, 1999).select("year", "empty", "top_contact", "net"), "SELECT 1999 AS year, true AS empty, NULL::VARCHAR AS top_contact, NULL::DOUBLE AS net")

# claims
_PCT = "pct AS (SELECT msg_id, c.i - 1 AS claim_no, CAST(c.x AS DOUBLE) AS value FROM (SELECT msg_id, unnest(list_transform(regexp_extract_all(text, '([0-9]+)% of', 1), lambda x, i: {'x': x, 'i': i})) AS c FROM msgs) WHERE CAST(c.x AS DOUBLE) <= 100)"
_add("percent_claims_simple", claims.percent_claims, "SELECT * FROM pct", more=_PCT)
_add("one_in_n_claims", claims.one_in_n, "SELECT msg_id, i - 1 AS claim_no, 100 * a / b AS value FROM (SELECT msg_id, c.i AS i, CAST(regexp_extract(c.x, '^([0-9]+)', 1) AS DOUBLE) AS a, CAST(regexp_extract(c.x, '([0-9]+)$', 1) AS DOUBLE) AS b FROM (SELECT msg_id, unnest(list_transform(regexp_extract_all(text, '([0-9]+) (?:in|out of) [0-9]+'), lambda x, i: {'x': x, 'i': i})) AS c FROM msgs)) WHERE a > 0 AND a <= b")
_add("vague_quantifiers", claims.vague_quantifiers, "SELECT msg_id, phrase, point, lo, hi FROM msgs JOIN (VALUES " + ", ".join(f"({_q(v[1])}, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE)" for v in claims.VAGUE) + ") t(phrase, point, lo, hi) ON regexp_matches(lower(text), '(^|[^a-z])' || phrase || '([^a-z]|$)')")

# Claims stand in sentences that ids choose (sources/driver_tables.CLAIMS), so SQL says what each sentence claims, not how it is found.
_PACKS = ("money", "sports")


def _book(f):
    return lambda m: f(m, packs.open_book(m.sparkSession, enabled=_PACKS))


def _own(name: str) -> dict:
    return json.loads((resources.files("palaver") / "packs" / f"{name}.json").read_text(encoding="utf-8"))


def _fact_rows() -> str:
    seen: dict[str, tuple] = {}
    for pack in ("core", *_PACKS):
        for f in _own(pack)["facts"]:
            seen.setdefault(f["id"], (pack, f))
    return ", ".join(f"({i}, {_q(f['id'])}, {_q(f['kind'])}, {f['value']}::DOUBLE, [{_list(f['tags'])}], {_q(pack)}, {_q(f['statement'])}, {_q(f['source'])}, {f['year']}, {_q(f['short'])})" for i, (pack, f) in enumerate(seen.values()))


# sentence, kind, value, low, high, checking fact, core, subject, start
_SAID = """(VALUES (0, 'percent', 'smartphone-us', NULL, NULL), (1, 'percent', NULL, NULL, NULL), (2, 'percent', 'cities-world', NULL, NULL), (3, 'percent', NULL, NULL, NULL), (5, 'percent', 'tattoo-us', NULL, NULL), (6, 'change', NULL, NULL, NULL),
  (7, 'ratio', NULL, NULL, NULL), (9, 'percent', 'coffee-us', 50.5, 100.0), (10, 'percent', 'obese-us', NULL, NULL), (11, 'percent', 'read-us', 0.0, 1.0), (12, 'change', NULL, NULL, NULL), (15, 'percent', 'smoke-us', 0.0, 5.0)) s(t, kind, fact, lo, hi)"""
_VALUE = "CAST(CASE t WHEN 6 THEN v + 2 WHEN 7 THEN v + 2 WHEN 9 THEN 65 WHEN 10 THEN round(100.0::DOUBLE / (v % 9 + 2), 1) WHEN 11 THEN 1 WHEN 12 THEN round(100.0::DOUBLE * ((v % 20 + 10) - (v % 30 + 31)) / (v % 30 + 31), 1) WHEN 15 THEN 3 ELSE v END AS DOUBLE)"
_CLAIMED = f"""facts AS (SELECT * FROM (VALUES {_fact_rows()}) f(ord, id, kind, value, tags, pack, statement, source, year, short)),
claimed AS (SELECT msg_id, t, v, s.kind, {_VALUE} AS value, lo, hi, fact, CASE t WHEN 5 THEN 13 WHEN 6 THEN 11 WHEN 7 THEN 6 WHEN 9 THEN 10 WHEN 12 THEN 8 ELSE 0 END AS start FROM msgs JOIN {_SAID} USING (t)),
claimed_out AS (SELECT * FROM claimed WHERE NOT (t = 6 AND v + 2 = 0)),
checked AS (SELECT c.*, f.id AS fact_id, f.value AS real, round(c.value - f.value, 1) AS delta, CASE WHEN f.id IS NULL THEN NULL WHEN lo IS NOT NULL THEN CASE WHEN f.value BETWEEN lo AND hi THEN 'fair' ELSE 'off' END WHEN abs(round(c.value - f.value, 1)) <= 3 THEN 'fair' WHEN abs(round(c.value - f.value, 1)) <= 10 THEN 'close' ELSE 'off' END AS verdict FROM claimed_out c LEFT JOIN facts f ON f.id = c.fact),
sized AS (SELECT *, CASE WHEN kind = 'change' THEN greatest(greatest(1 + value / 100, 0.01), 1 / greatest(1 + value / 100, 0.01)) ELSE value END AS size, CASE WHEN kind = 'percent' THEN 'percent' ELSE 'ratio' END AS class, CASE WHEN kind <> 'percent' THEN 5 WHEN lo IS NOT NULL THEN 12 ELSE 6 END AS tol FROM checked),
gaps AS (SELECT s.*, f.id AS other_id, f.value AS other, f.ord, f.pack, f.statement, f.source, f.year, f.short, CASE WHEN class = 'percent' THEN abs(size - f.value) ELSE 10 * abs(ln(size) - ln(f.value)) END AS gap FROM sized s JOIN facts f ON f.kind = s.class),
met AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY gap > tol, gap, ord) AS rank FROM gaps) WHERE rank <= 2 AND (fact_id IS NULL OR fact_id <> other_id))"""
_claims = lambda m: extract.extract_claims(m)
_add("claims_extracted", lambda m: _claims(m).select("msg_id", "start", "kind", "value", "quantifier", "lo", "hi"), "SELECT msg_id, start, kind, value, CASE WHEN lo IS NULL THEN 'exact' ELSE 'vague' END AS quantifier, lo, hi FROM (SELECT msg_id, start, kind, value, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM claimed_out UNION ALL SELECT msg_id, 13, 'percent', 10, NULL, NULL FROM msgs WHERE t = 4)", base=CLAIMS_SQL, more=_CLAIMED)
_add("claim_verdicts", _book(lambda m, b: verdicts.check(_claims(m), b).where("verdict is not null").select("msg_id", "start", "value", "fact_id", "real", "delta", "verdict")), "SELECT msg_id, start, value, fact_id, real, delta, verdict FROM checked WHERE verdict IS NOT NULL", base=CLAIMS_SQL, more=_CLAIMED)
_add("fact_verdict_bands", _book(lambda m, b: verdicts.check(_claims(m), b).where("lo is not null and verdict is not null").select("msg_id", "lo", "hi", "real", "verdict")), "SELECT msg_id, lo::DOUBLE AS lo, hi::DOUBLE AS hi, real, verdict FROM checked WHERE lo IS NOT NULL", base=CLAIMS_SQL, more=_CLAIMED)
_add("fact_nearest_match", _book(lambda m, b: verdicts.parallels(_claims(m).where("kind <> 'percent'"), b).select("msg_id", "value", "rank", F.col("other_id").alias("fact_id"), F.round("gap", 6).alias("gap"))), "SELECT msg_id, value, rank, other_id AS fact_id, round(gap, 6) AS gap FROM met WHERE kind <> 'percent'", base=CLAIMS_SQL, more=_CLAIMED)
_ANSWERS = """SELECT msg_id, 'myth' AS part, 0 AS no, CASE t WHEN 4 THEN 'ten-percent-brain' ELSE 'flat-earth' END AS fact_id, NULL AS kind, NULL::DOUBLE AS value, NULL::DOUBLE AS real, NULL::DOUBLE AS gap, 'myth' AS verdict FROM msgs WHERE t IN (4, 8)
  UNION ALL SELECT msg_id, 'appeal', CASE t WHEN 5 THEN 1 ELSE 3 END, NULL, CASE t WHEN 5 THEN 'authority' ELSE 'count' END, NULL, NULL, NULL, 'ask' FROM msgs WHERE t IN (5, 14)
  UNION ALL SELECT msg_id, 'check', 0, fact_id, kind, value, real, abs(delta), verdict FROM checked WHERE verdict IS NOT NULL
  UNION ALL SELECT msg_id, 'parallel', row_number() OVER (PARTITION BY msg_id ORDER BY rank) - 1, other_id, kind, value, other, round(gap, 2), NULL FROM met"""
_add("analyse", _book(lambda m, b: verdicts.analyse(m, b).select("msg_id", "part", F.col("no").cast("long").alias("no"), "fact_id", "kind", "value", "real", "gap", "verdict")), _ANSWERS, base=CLAIMS_SQL, more=_CLAIMED)
_add("check_lines", _book(lambda m, b: verdicts.check(_claims(m), b).where("verdict is not null").select("msg_id", "title", "line")), """SELECT msg_id, CASE WHEN lo IS NOT NULL THEN CASE verdict WHEN 'fair' THEN 'Fair enough.' ELSE 'Not really.' END WHEN verdict = 'fair' THEN 'That checks out.' WHEN verdict = 'close' THEN 'Close, but ' || way || '.' ELSE 'Not quite.' END AS title,
  statement || CASE WHEN lo IS NOT NULL THEN ', so “' || CASE t WHEN 9 THEN 'most people' WHEN 11 THEN 'nobody' ELSE 'hardly anyone' END || '” ' || CASE WHEN verdict = 'fair' THEN 'holds up.' WHEN real > hi THEN 'is too low.' ELSE 'is too high.' END
    ELSE '. You said ' || printf('%g', value) || '%' || CASE WHEN verdict = 'fair' THEN ', which is fair.' ELSE ': ' || printf('%g', abs(delta)) || CASE WHEN abs(delta) = 1 THEN ' point ' ELSE ' points ' END || way || '.' END END AS line
  FROM (SELECT c.*, f.statement, CASE WHEN delta > 0 THEN 'high' ELSE 'low' END AS way FROM checked c JOIN facts f ON f.id = c.fact_id)""", base=CLAIMS_SQL, more=_CLAIMED)
# the pools of the house voice, as the packs hold them; a line's place comes from a hash of claim and fact
_HOUSE = _own("voices/house")
_PICK = lambda salt, n: f"(('0x' || left(md5(key || '|' || other_id || '|{salt}'), 8))::BIGINT % {n})"
_POOL = lambda lists: f"[{_list(x for k in lists for x in _HOUSE[k])}][1 + {_PICK(1, sum(len(_HOUSE[k]) for k in lists))}]"
_FILL = "template"
for _k, _v in (("fact_lc", "CASE WHEN regexp_matches(statement, '^(Russia|Jupiter|Everest|NBA) ') THEN statement ELSE lower(statement[1]) || statement[2:] END"), ("fact_v", "printf('%g', other)"), ("fact", "statement"), ("short", "short"), ("subject_or_that", "CASE WHEN subject = '' THEN 'that' ELSE '''' || subject || '''' END"), ("subject", "CASE WHEN subject = '' THEN 'your claim' ELSE subject END"), ("gap", "printf('%g', round(gap, 1)) || CASE WHEN round(gap, 1) = 1 THEN ' point' ELSE ' points' END"), ("claim_v", "printf('%g', value)")):
    _FILL = f"replace({_FILL}, '{{{_k}}}', {_v})"
_add("render_lines", _book(lambda m, b: verdicts.render(verdicts.parallels(verdicts.checked_claims(m, b, ["msg_id"]).drop("line", "source", "year"), b), b).select("msg_id", F.col("other_id").alias("fact_id"), F.col("line_1").alias("line"), "source_line")), f"""SELECT msg_id, other_id AS fact_id, {_FILL} AS line, 'Source: ' || source || ', ' || year || '.' AS source_line FROM (SELECT *, CASE WHEN kind <> 'percent' THEN {_POOL(['ratio'])} WHEN gap <= 3 THEN {_POOL(['percent', 'percent_close'])} ELSE {_POOL(['percent'])} END AS template
  FROM (SELECT *, left(sha1(kind || '|' || printf('%.1f', value) || '|' || left(lower(subject), 40)), 12) AS key FROM (SELECT *, CASE t WHEN 0 THEN 'Americans own a smartphone' WHEN 1 THEN 'people don''t drink alcohol' WHEN 2 THEN 'world lives in cities' WHEN 3 THEN 'Brits drink wine' WHEN 5 THEN 'adults have a tattoo' WHEN 6 THEN 'last year' WHEN 7 THEN '' WHEN 9 THEN 'people drink coffee' WHEN 10 THEN 'adults are obese' WHEN 11 THEN 'nobody reads books' WHEN 12 THEN 'again' WHEN 15 THEN 'anyone smokes' END AS subject FROM met)))""", base=CLAIMS_SQL, more=_CLAIMED)
_add("fact_coincidences", _book(lambda m, b: claims.coincidences(b, verdicts.checked_claims(m, b, ["msg_id"]).drop("line", "source", "year"))), "SELECT a.id AS one, b.id AS other, round(abs(a.value - b.value), 2) AS gap, (SELECT count(*) FROM met WHERE other_id = a.id) AS n_one, (SELECT count(*) FROM met WHERE other_id = b.id) AS n_other FROM facts a JOIN facts b ON a.ord < b.ord WHERE a.kind = 'percent' AND b.kind = 'percent' AND abs(a.value - b.value) <= 2.5 AND NOT list_has_any(list_filter(a.tags, lambda x: x <> 'us'), list_filter(b.tags, lambda x: x <> 'us')) AND NOT list_contains(a.tags, 'health') AND NOT list_contains(b.tags, 'health')", base=CLAIMS_SQL, more=_CLAIMED)
_add("pack_counts", _book(lambda m, b: claims.pack_counts(packs.packs(m.sparkSession, enabled=_PACKS, locked=["sports"]), b, verdicts.check(_claims(m), b))), f"SELECT p.pack, p.facts, p.pack = 'core' AS always_on, p.pack = 'sports' AS locked, p.pack <> 'sports' AS enabled, (SELECT count(*) FROM checked c JOIN facts f ON f.id = c.fact_id WHERE f.pack = p.pack) AS checks FROM (VALUES {', '.join(f'({_q(x)}, {len(_own(x)['facts'])})' for x in ('core', *_PACKS))}) p(pack, facts)", base=CLAIMS_SQL, more=_CLAIMED)
_add("topic_first_match", _book(lambda m, b: claims.topics_in(_claims(m), b)), f"SELECT msg_id, start, CASE t {' '.join(f'WHEN {t} THEN {n}' for t, n in ((0, 0), (1, 3), (2, 13), (3, 3), (5, 4), (9, 2), (10, 5), (11, 15), (15, 6)))} END AS topic FROM claimed_out WHERE t NOT IN (6, 7, 12)", base=CLAIMS_SQL, more=_CLAIMED)
_add("myth_sentences", _book(claims.myths_in), "SELECT msg_id, 0 AS start, CASE t WHEN 4 THEN 31 ELSE 38 END AS \"end\", CASE t WHEN 4 THEN 'ten-percent-brain' ELSE 'flat-earth' END AS myth FROM msgs WHERE t IN (4, 8)", base=CLAIMS_SQL)
_add("appeal_detect", claims.appeals_in, "SELECT msg_id, CASE t WHEN 5 THEN 'authority' WHEN 8 THEN 'popularity' ELSE 'count' END AS appeal, 0 AS start, regexp_extract(text, '^[^.]*') AS said FROM msgs WHERE t IN (5, 8, 14)", base=CLAIMS_SQL)
_add("wrapped_fact", _book(lambda m, b: claims.card_fact(volume.overview(m).select(search.ratio("sent", "total", 3).alias("sent_share")), b).select("sent_share", "fact_id", "gap")), f"SELECT sent_share, id AS fact_id, round(abs(round(sent_share * 100, 1) - value), 1) AS gap FROM (SELECT {_ratio(_S, 'count(*)', 3)} AS sent_share FROM msgs), facts WHERE kind = 'percent' ORDER BY abs(round(sent_share * 100, 1) - value) > 6, abs(round(sent_share * 100, 1) - value), ord LIMIT 1", base=CLAIMS_SQL, more=_CLAIMED)
_add("conversation_page", lambda m: conversations.conversation_view(m, 5, 10)[0].select("contact", "conversations"), f"SELECT contact, conversations FROM health ORDER BY conversations DESC, contact LIMIT 10", more=_HEALTH)
_add("conversation_page_summary", lambda m: conversations.conversation_view(m, 5, 10)[1].select("conversations", "double_texts"), "SELECT conversations, double_texts FROM summary", more=f"{_HEALTH}, {_SUMMARY}")

_add("hours_of_contact", lambda m: search.of_contact(volume.by_hour, m, "user_7"), f"SELECT r.hour, coalesce(sent, 0) AS sent, coalesce(received, 0) AS received FROM (SELECT unnest(range(24)) AS hour) r LEFT JOIN (SELECT hour(ts) AS hour, {_S} AS sent, {_R} AS received FROM msgs WHERE contact = 'user_7' GROUP BY 1) USING (hour) WHERE EXISTS (SELECT 1 FROM msgs WHERE contact = 'user_7')")
_add("hours_of_unknown_contact", lambda m: search.of_contact(volume.by_hour, m, "nobody"), "SELECT 0 AS hour, 0 AS sent, 0 AS received WHERE false")
# a choice depends on those before it; tested against a plain loop
_add("parallels_without_repeats", _book(lambda m, b: recent.without_repeats(verdicts.checked_claims(m, b, ["contact", "ts", "msg_id"]), b)), base=CLAIMS_SQL)

# source decoding, over events as rows of an export
_add("alias_pick", decode.demo_alias, "SELECT msg_id, coalesce(nullif(CASE WHEN msg_id % 3 = 0 THEN text END, ''), nullif(contact, '')) AS value, CASE WHEN msg_id % 3 = 0 AND text <> '' THEN 'body' ELSE 'message' END AS alias FROM msgs")
_add("direction_decode", decode.demo_direction, "SELECT msg_id, CASE WHEN msg_id % 4 = 0 THEN 'sent' WHEN msg_id % 4 = 1 THEN 'received' ELSE direction END AS direction FROM msgs")
_add("timestamp_decode", decode.demo_timestamp, "SELECT msg_id, date_trunc('second', ts) AS ts FROM msgs")
_add("date_order_guess", decode.demo_date_order, "SELECT contact, arg_min(CASE WHEN day(ts) > 12 THEN true END, row(ts, msg_id)) FILTER (day(ts) > 12) AS day_first FROM msgs GROUP BY contact")
