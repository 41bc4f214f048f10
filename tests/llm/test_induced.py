import random

from plumbline.llm import induced, repeats


def test_orders_equal_plain_sorting(monkeypatch):
    rng = random.Random(9)
    for chunk, held, run in ((1 << 14, 256, 1 << 20), (2, 1, 3)):
        monkeypatch.setattr(induced, "CHUNK", chunk)
        monkeypatch.setattr(induced, "HELD", held)
        monkeypatch.setattr(induced, "RUN", run)
        monkeypatch.setattr(induced.sorted_runs, "__defaults__", (run,))
        for k in range(250):
            body = bytes(rng.choices(range(1, rng.choice([2, 3, 5, 200])), k=rng.randint(0, 60)))
            if k % 5 == 0:
                body = body[:7] * 9
            t = body + b"\0"
            assert list(induced.suffix_order(t)) == sorted(range(len(t)), key=lambda i: t[i:]), t


def test_queues_of_a_shard_lie_in_files(monkeypatch):
    """The sort as the query calls it, over a shard whose queues and names go through files."""
    files, real = [], induced.tempfile.TemporaryFile
    monkeypatch.setattr(induced.tempfile, "TemporaryFile", lambda: files.append(real()) or files[-1])
    monkeypatch.setattr(induced, "CHUNK", 64)
    monkeypatch.setattr(induced, "HELD", 4)
    monkeypatch.setattr(induced, "RUN", 500)
    monkeypatch.setattr(induced.sorted_runs, "__defaults__", (500,))
    rng = random.Random(5)
    shared = "".join(rng.choices("abcd ", k=400)).encode()
    segments = [(d, d << 12, rng.randbytes(50).translate(bytes(97 + b % 5 for b in range(256))) + shared[d : d + 150 + d]) for d in range(40)]
    found = sorted(set(repeats.repeated(segments)))
    least, want = {}, set()
    for d, start, raw in sorted(segments):
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in least:
                want.add((d, start + s))
            else:
                least[raw[s : s + 100]] = d
    assert found == sorted(want) and len(files) > 5
