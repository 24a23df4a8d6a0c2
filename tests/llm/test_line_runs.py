from isohyet.llm import line_chunks, queries


def lines_of(text):
    return [x for x in (text or "").split("\n") if x.encode().split()]


def brute_shared(texts, most=50):
    """For texts in order: which lines with words stand in a run of over `most` words that an earlier text has too."""
    out, before = [], []
    for text in texts:
        own = lines_of(text)
        size, gone = [len(x.encode().split()) for x in own], [False] * len(own)
        for other in before:
            reach = [0] * (len(other) + 1)  # the common run that ends at the line before and here
            for i, line in enumerate(own):
                now = [0] * (len(other) + 1)
                for j, x in enumerate(other):
                    if x == line:
                        now[j + 1] = n = reach[j] + 1
                        if sum(size[i + 1 - n : i + 1]) > most:
                            gone[i + 1 - n : i + 1] = [True] * n
                reach = now
        out.append(gone)
        before.append(own)
    return out


def expected(texts, gone, least=2):
    """The lines that stay: neither in a shared run nor in a chunk that was there before."""
    seen, out = {}, []
    for d, (text, flags) in enumerate(zip(texts, gone)):
        flags, at = list(flags), 0
        for place, (chunk, n) in enumerate(line_chunks.chunks_of(text) if text else ()):
            if n >= least and seen.setdefault(chunk, (d, place)) != (d, place):
                flags[at : at + n] = [True] * n
            at += n
        out.append([x for x, g in zip(lines_of(text), flags) if not g])
    return out


def test_runs_against_brute_force(spark):
    line = lambda name, n=13: f"{name} " + " ".join(f"w{i}" for i in range(n - 1))
    texts = []
    for k in range(40):  # passages of one to six lines between own lines
        passage = "\n".join(line(f"p{k % 10}-{i}", 60 if k % 10 == 0 else 13) for i in range(1 + k % 10 % 6))
        texts.append("\n".join([line(f"a{k}"), line(f"b{k}")][: k % 3] + [passage] + ["", line(f"c{k}"), line(f"d{k}"), line(f"e{k}")][: k % 5]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_chunks.line_chunk_dedup(rows, run_words=50).collect()}
    gone = brute_shared(texts)
    assert sum(map(any, gone)) > 10
    for d, want in enumerate(expected(texts, gone)):
        assert lines_of(got[d].text) == want, d
        assert got[d].n_lines_removed == len(lines_of(texts[d])) - len(want)


def test_runs_of_a_whole_table(spark, sf_dir):
    own = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    texts = [t for _, t in own]
    want = dict(zip((d for d, _ in own), expected(texts, brute_shared(texts))))
    rows = queries.op4_line_chunks(spark, sf_dir).collect()
    assert len(rows) == len(own) and all(lines_of(r.text) == want[r.doc_id] for r in rows)


def test_copies_keep_no_last_line(spark):
    """Of an exact copy nothing stays, however many lines it has, even with few words in each."""
    texts = ["\n".join(f"t{n} line {i}" for i in range(n)) for n in range(2, 80)]
    assert all(n >= 2 for t in texts for _, n in line_chunks.chunks_of(t))
    rows = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_chunks.line_chunk_dedup(rows).collect()}
    assert [got[d] for d in range(2 * len(texts))] == texts + [""] * len(texts)


def test_repeated_single_lines(spark):
    """A text of one line of over 50 words is a run too; a shorter one stays."""
    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame(list(enumerate([long, short, long, short, f"own\n{long}"])), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_chunks.line_chunk_dedup(rows, run_words=50).collect()}
    assert got == {0: long, 1: short, 2: "", 3: short, 4: "own"}
