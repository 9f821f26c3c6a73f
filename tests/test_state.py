"""State across micro-batches against the one-row forms, and these against plain Python or SQLite."""

import random
import sqlite3
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers
from corpusloom.operators import chat, exports
from corpusloom.streaming import events, state

PIECES = "answer_id bigint, seq bigint, part int, text string, last boolean"
EVENTS = "queue string, seq bigint, kind string, slug string, zip_path string, zip_size bigint, error string"


def answers_made(n, seed):
    rng = random.Random(seed)
    said = ["Pumps move water. ", "Check the seal ", "é ß 你好 ", "\n\n", "  ", "Stop first. "]
    made = {}
    for i in range(n):
        parts = ["".join(rng.choices(said, k=rng.randrange(1, 6)))]
        for _ in range(rng.randrange(4)):
            told = parts[-1].strip()
            parts.append(rng.choice(["", told, told + " \n ", told[: len(told) // 2]]) + "".join(rng.choices(said, k=rng.randrange(4))))
        made[i] = parts
    return made


def cut(made, seed):
    rng, rows = random.Random(seed), []
    for i, parts in made.items():
        seq = 0
        for p, text in enumerate(parts, 1):
            marks = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(5))))
            pieces = [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)])]
            for j, piece in enumerate(pieces):
                rows.append((i, seq, p, piece, j == len(pieces) - 1))
                seq += 1
    return rows


def play(spark, make, rows, schema, folder, seed, restarts=2, files=6):
    """The output of a stream over ``rows`` in shuffled files, some rows twice, run in several goes from one checkpoint."""
    rng = random.Random(seed)
    rows = rows + rng.sample(rows, len(rows) // 5)
    rng.shuffle(rows)
    source, out, kept = f"{folder}/in", f"{folder}/out", f"{folder}/cp"
    per = -(-len(rows) // files)
    for go in range(restarts):
        for k in range(go, files, restarts):
            spark.createDataFrame(rows[k * per : (k + 1) * per], schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        run = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        assert run.awaitTermination(240)
    return spark.read.parquet(out).collect()


def test_answer_in_pieces_equals_the_one_row_form(spark, tmp_path):
    made = answers_made(25, 1)
    got = play(spark, lambda s: state.answer_stream(s, 40), cut(made, 2), PIECES, str(tmp_path), 3)
    assert len(got) == len(cut(made, 2))
    mine = {}
    for r in sorted(got, key=lambda r: (r.answer_id, r.seq)):
        draft, text = mine.get((r.answer_id, r.part), (r.draft, ""))
        assert draft == r.draft
        mine[r.answer_id, r.part] = (r.draft, text + r.text)
    whole = spark.createDataFrame(list(made.items()), "id bigint, parts array<string>").select("id", F.posexplode(answers.streamed_parts(F.col("parts"), 40)).alias("p", "s")).collect()
    assert mine == {(r.id, r.p + 1): (r.s.draft, r.s.text) for r in whole}


def test_one_row_form_by_hand(spark):
    parts = ["Stop first. ", "Stop first. \n Then look.", "Stop now", ""]
    (row,) = spark.createDataFrame([(parts,)], "parts array<string>").select(answers.streamed_parts(F.col("parts")).alias("s")).collect()
    assert [tuple(x) for x in row.s] == [("", "Stop first. "), ("Stop first.", "Then look."), ("Stop first.\n\nThen look.", "now"), ("Stop first.\n\nThen look.\n\nnow", "")]


def test_state_is_forgotten_after_the_time_to_live(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    spark.createDataFrame([], PIECES).write.parquet(source)
    stream = state.answer_stream(spark.readStream.schema(PIECES).parquet(source), ttl=timedelta(seconds=1))
    run = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for go in (1, 2):  # piece 0 again would be a repeat if the answer were still known
            spark.createDataFrame([(1, 0, 1, "Stop. ", True)], PIECES).write.mode("append").parquet(source)
            end = time.time() + 60
            while time.time() < end and not (out.exists() and spark.read.schema("answer_id bigint").parquet(str(out)).count() == go):
                time.sleep(1)
            time.sleep(3)
    finally:
        run.stop()
    assert spark.read.parquet(str(out)).count() == 2


class Exports:
    """The job table by SQL statements."""

    def __init__(self):
        self.db = sqlite3.connect(":memory:")
        self.db.executescript("CREATE TABLE slot (slug TEXT); CREATE TABLE line (position INTEGER PRIMARY KEY AUTOINCREMENT, slug TEXT UNIQUE); CREATE TABLE job (slug TEXT PRIMARY KEY, state TEXT, zip TEXT, error TEXT);")

    def one(self, sql, *args):
        row = self.db.execute(sql, args).fetchone()
        return row[0] if row else None

    def put(self, slug, state_, zip_=None):
        self.db.execute("INSERT INTO job VALUES (?, ?, ?, '') ON CONFLICT(slug) DO UPDATE SET state = excluded.state, zip = excluded.zip", (slug, state_, zip_))

    def start(self, slug):
        self.db.execute("DELETE FROM slot")
        self.db.execute("INSERT INTO slot VALUES (?)", (slug,))
        self.put(slug, "building")
        return slug

    def release(self, slug):
        if self.one("SELECT slug FROM slot") != slug:
            return None
        self.db.execute("DELETE FROM slot")
        following = self.one("SELECT slug FROM line ORDER BY position LIMIT 1")
        if following is None:
            return None
        self.db.execute("DELETE FROM line WHERE slug = ?", (following,))
        return self.start(following)

    def apply(self, kind, slug, zip_):
        started, slot = None, self.one("SELECT slug FROM slot")
        if kind == "requested":
            now, path = self.one("SELECT state FROM job WHERE slug = ?", slug), self.one("SELECT zip FROM job WHERE slug = ?", slug)
            if self.one("SELECT 1 FROM line WHERE slug = ?", slug) or (slot == slug and (now == "building" or (now == "ready" and path))):
                pass
            elif slot is not None:
                self.db.execute("INSERT OR IGNORE INTO line (slug) VALUES (?)", (slug,))
                self.put(slug, "queued")
            else:
                started = self.start(slug)
        elif kind == "built":
            if slot == slug:
                self.put(slug, "ready", zip_)
        elif kind == "failed":
            self.put(slug, "failed")
            started = self.release(slug)
        elif kind == "fetched":
            if self.one("SELECT count(*) FROM job WHERE slug = ? AND coalesce(zip, '') = ?", slug, zip_ or ""):
                self.put(slug, "idle")
            started = self.release(slug)
        elif kind == "removed":
            self.db.execute("DELETE FROM job WHERE slug = ?", (slug,))
            self.db.execute("DELETE FROM line WHERE slug = ?", (slug,))
            started = self.release(slug)
        elif kind == "lost":
            self.db.execute("UPDATE job SET state = 'failed', zip = NULL WHERE slug = ? AND state = 'ready'", (slug,))
        position = self.one("SELECT count(*) FROM line WHERE position <= (SELECT position FROM line WHERE slug = ?)", slug) or None
        return self.one("SELECT state FROM job WHERE slug = ?", slug) or "idle", position, started


def log(n, seed):
    rng, rows = random.Random(seed), []
    kinds = ["requested"] * 4 + ["built", "built", "fetched", "failed", "removed", "lost", "noise"]
    for q in ("a", "b", "c"):
        for seq in range(n):
            slug = f"s{rng.randrange(6)}"
            rows.append((q, seq, rng.choice(kinds), slug, rng.choice([None, f"/{slug}.zip", f"/{slug}.zip"]), rng.choice([None, 5]), rng.choice([None, "full"])))
    return rows


def by_sqlite(rows):
    queues, out = {}, {}
    for q, seq, kind, slug, path, _, _ in sorted(rows, key=lambda r: r[:2]):
        out[q, seq] = (kind, slug, *queues.setdefault(q, Exports()).apply(kind, slug, path))
    return out


def told(rows):
    return {(r.queue, r.seq): (r.kind, r.slug, r.state, r.position, r.started) for r in rows}


def test_export_fold_equals_sqlite(spark):
    rows = log(300, 1)
    assert told(exports.fold(spark.createDataFrame(rows + rows[:50], EVENTS)).collect()) == by_sqlite(rows)


def test_export_stream_equals_sqlite_over_restarts(spark, tmp_path):
    rows = log(70, 2)
    assert told(play(spark, state.export_stream, rows, EVENTS, str(tmp_path), 5)) == by_sqlite(rows)


def test_last_state_of_each_slug(spark):
    rows = [("a", 0, "requested", "x", None, None, None), ("a", 1, "requested", "y", None, None, None), ("a", 2, "failed", "x", None, None, "full"), ("a", 3, "built", "y", "/y", 1, None)]
    folded = exports.fold(spark.createDataFrame(rows, EVENTS))
    assert {(r.slug, r.state) for r in exports.states(folded).collect()} == {("x", "failed"), ("y", "ready")}
    assert {(r.slug, r.state) for r in exports.states(folded.where("seq < 3")).collect()} == {("x", "failed"), ("y", "building")}


def test_line_equals_a_list():
    rng, line, plain = random.Random(5), exports.Line(["s1", "s2"]), ["s1", "s2"]
    for _ in range(4000):
        slug = f"s{rng.randrange(300)}"
        act = rng.choice(["join", "join", "leave", "first"])
        if act == "join":
            line.join(slug)
            plain += [slug] if slug not in plain else []
        elif act == "leave":
            line.leave(slug)
            plain = [x for x in plain if x != slug]
        elif plain:
            assert line.pop_first() == plain.pop(0)
        assert line.place(slug) == (plain.index(slug) + 1 if slug in plain else None)
        assert len(line) == len(plain) and (slug in line) == (slug in plain)
    assert list(line) == plain


def test_long_lines_cost_no_square():
    n, queue, began = 100_000, exports.Queue(), time.process_time()
    places = [queue.apply("requested", f"s{i}", None, None, None)[3] for i in range(n)]
    assert places == [None, *range(1, n)]
    started = [queue.apply("removed", f"s{i}", None, None, None)[4] for i in range(n // 2)]
    assert started == [f"s{i + 1}" for i in range(n // 2)]
    assert queue.apply("requested", f"s{n - 1}", None, None, None)[3] == n - 1 - n // 2
    assert time.process_time() - began < 20


def test_many_queues_in_few_tasks_equal_sqlite(spark):
    rows = [(f"{q}{i}", *rest) for i in range(7) for q, *rest in log(40, 10 + i)]
    none = [(None, *rest) for q, *rest in log(60, 30) if q == "a"]
    random.Random(1).shuffle(rows)
    found = exports.fold(spark.createDataFrame(rows + none + none[:9], EVENTS)).collect()
    assert len(found) == len(rows) + len(none)
    assert told(r for r in found if r.queue is not None) == by_sqlite(rows)
    assert {k[1]: v for k, v in told(r for r in found if r.queue is None).items()} == {k[1]: v for k, v in by_sqlite(none).items()}


MESSAGES = "id bigint, session_id string, created_at timestamp, role string, content string, sources_json string"


def test_replayed_messages_change_nothing(spark, tmp_path):
    at = datetime(2024, 1, 1)
    cite = '[{"doc_name": "m.pdf", "doc_path": "/m"}, {"doc_name": " ", "doc_path": "/n"}, {"doc_name": "", "doc_path": ""}]'
    rows = [(i, f"s{i % 3}", at + timedelta(minutes=i), "assistant" if i % 2 else "user", f"text {i}", cite if i % 2 else None) for i in range(12)]
    source, path = str(tmp_path / "in"), str(tmp_path / "chat")
    counts = lambda: [spark.read.parquet(f"{path}/{t}").count() for t in ("sessions", "messages", "sources")]
    for go, batch in enumerate([rows[:6] + rows[:3], rows[4:10], rows]):
        spark.createDataFrame(batch, MESSAGES).write.mode("append").parquet(source)
        run = events.chat_log(spark.readStream.schema(MESSAGES).parquet(source), path, str(tmp_path / "cp"), "1 day")
        assert run.awaitTermination(240)
    assert counts() == [3, 12, 12]
    # a new checkpoint replays everything
    run = events.chat_log(spark.readStream.schema(MESSAGES).parquet(source), path, str(tmp_path / "cp2"), "1 day")
    assert run.awaitTermination(240)
    assert counts() == [3, 12, 12]
    first = {r.session_id: r.created_at for r in spark.read.parquet(f"{path}/sessions").collect()}
    assert first == {f"s{i}": at + timedelta(minutes=i) for i in range(3)}
    assert {r.doc_name for r in spark.read.parquet(f"{path}/sources").collect()} == {"m.pdf", "(unknown)"}


def test_insert_or_ignore_with_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id bigint, v string")
    stored = spark.createDataFrame([(2, "x")], "id bigint, v string")
    assert sorted((r.id or 0, r.v) for r in chat.insert_or_ignore(rows, stored, ("id",), ("v",)).collect()) == [(0, "c"), (1, "a")]
    again = chat.insert_or_ignore(rows, stored.unionByName(rows), ("id",))
    assert again.count() == 0


@pytest.mark.parametrize("text, want", [("abc", (3, "")), ("ab", (2, "")), ("abx", (-1, "x")), ("abc  d", (-1, "d")), ("x", (-1, "x"))])
def test_unrepeated(text, want):
    assert state.unrepeated("abc", 0, text) == want
