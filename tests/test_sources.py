import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkset import Dataset, IterableDataset, SplitDict, from_arrow, from_csv, from_json, from_parquet, from_text, load_dataset, parse
from sparkset.sources import builder, formats, hub, loader, registry, resolve
from sparkset.sources.download import DownloadManager


def rows(d):
    return d.to_list()


def test_detect():
    assert formats.detect("a/b.NDJSON")[0] == "jsonl" and formats.detect("x.tsv") == ("csv", {"delimiter": "\t"})
    with pytest.raises(formats.UnknownFormat):
        formats.detect("x.xml")


def test_csv_cells_survive(spark, tmp_path):
    hard = [{"a": 'x,"y"\nz', "b": None, "c": [1, 2], "d": {"k": "v"}}, {"a": "", "b": "2", "c": None, "d": None}]
    d = Dataset.from_list(spark, hard, "a string, b string, c array<int>, d struct<k:string>")
    d.to_csv(str(tmp_path / "d" / "x.csv"))
    back = rows(from_csv(spark, str(tmp_path / "d" / "x.csv")))
    assert back[0]["a"] == 'x,"y"\nz' and back[0]["c"] == "[1,2]" and back[0]["d"] == '{"k":"v"}' and back[1]["b"] == "2"


def test_csv_reading(spark, tmp_path):
    (tmp_path / "x.csv").write_text("name,age\nAnn, 3\nBob,4\n")
    assert rows(from_csv(spark, str(tmp_path / "x.csv"), quoting="naive")) == [{"name": "Ann", "age": "3"}, {"name": "Bob", "age": "4"}]
    assert from_csv(spark, str(tmp_path / "x.csv"), headers=False).column_names == ["column_1", "column_2"]
    (tmp_path / "x.tsv").write_text("a\tb\n1\t\n")
    assert rows(parse(spark, str(tmp_path / "x.tsv"))) == [{"a": "1", "b": None}]


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1}, {"n": 2}]')
    (tmp_path / "b.json").write_text('{"n": 3}')
    (tmp_path / "c.jsonl").write_text('{"n": 4}\n\n{"n": 5}\n')
    assert [[r["n"] for r in rows(from_json(spark, str(tmp_path / x)))] for x in ("a.json", "b.json", "c.jsonl")] == [[1, 2], [3], [4, 5]]
    (tmp_path / "bad.jsonl").write_text('{"n": 4}\n{oops\n')
    with pytest.raises(Exception):
        rows(from_json(spark, str(tmp_path / "bad.jsonl"), schema="n long"))
    d = from_json(spark, str(tmp_path / "a.json"))
    d.to_json(str(tmp_path / "o.json"), orient="columns")
    assert json.loads((tmp_path / "o.json").read_text()) == {"n": [1, 2]}
    d.to_json(str(tmp_path / "p.json"), pretty=True)
    assert json.loads((tmp_path / "p.json").read_text()) == [{"n": 1}, {"n": 2}]
    with pytest.raises(ValueError):
        d.to_json(str(tmp_path / "q.json"), orient="rows")


def test_bytes_become_text_or_base64(spark, tmp_path):
    Dataset.from_list(spark, [{"b": b"ok"}, {"b": b"\xff\xfe"}], "b binary").to_jsonl(str(tmp_path / "b.jsonl"))
    assert [json.loads(x)["b"] for x in (tmp_path / "b.jsonl").read_text().splitlines()] == ["ok", "base64://4="]


def test_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("  один \n\n二\nثلاثة\n")
    assert [r["text"] for r in rows(from_text(spark, str(tmp_path / "t.txt")))] == ["один", "二", "ثلاثة"]
    assert len(rows(from_text(spark, str(tmp_path / "t.txt"), strip=False, skip_empty=False, column="l"))) == 4
    Dataset.from_list(spark, [{"text": "a"}, {"text": None}], "text string").to_text(str(tmp_path / "o.txt"))
    assert (tmp_path / "o.txt").read_text() == "a\n\n"


def test_parquet_keeps_the_order_of_files(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/a")
    spark.range(100, 5000).coalesce(1).write.parquet(f"file://{tmp_path}/b")
    d = from_parquet(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"])
    assert [r["id"] for r in rows(d.take(5))] == [0, 1, 2, 100, 101] and d.shard(2, 1).to_list()[-1]["id"] == 4999


def test_arrow(spark, tmp_path):
    d = Dataset.from_list(spark, [{"name": f"n{i}", "age": i, "score": i / 2} for i in range(7)])
    d.to_arrow(str(tmp_path / "x.arrow"), compression="lz4", batch_rows=3)
    back = from_arrow(spark, str(tmp_path / "x.arrow"))
    assert rows(back) == rows(d) and back.frame.rdd.getNumPartitions() == 3
    assert formats.is_arrow(str(tmp_path / "x.arrow")) and from_arrow(spark, str(tmp_path / "x.arrow"), columns=["age"]).column_names == ["age"]
    d.to_arrow(str(tmp_path / "s.arrows"), stream=True)
    import pyarrow as pa

    assert pa.ipc.open_stream(str(tmp_path / "s.arrows")).read_all().num_rows == 7


def test_mixed_formats_and_repositories(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "train.jsonl").write_text('{"id": 1, "text": "a"}\n{"id": 2, "text": "b"}\n')
    (tmp_path / "data" / "test.jsonl").write_text('{"id": 3, "text": "c"}\n')
    (tmp_path / "README.md").write_text("#")
    both = load_dataset(spark, str(tmp_path))
    assert isinstance(both, SplitDict) and both.num_rows == {"test": 1, "train": 2}
    assert [r["id"] for r in load_dataset(spark, str(tmp_path), split="train", streaming=True).take(1)] == [1]
    with pytest.raises(resolve.SplitNotFound):
        load_dataset(spark, str(tmp_path), split="validation")
    with pytest.raises(ValueError):
        load_dataset(spark, str(tmp_path), streaming=True)
    assert resolve.resolve(["main/train-0.parquet", "main/test-0.parquet", "alt/train-0.parquet"])[0] == "main"
    assert resolve.resolve(["x.csv"])[1] == {"train": ["x.csv"]}
    assert {f["path"] for f in resolve.HadoopSource(spark).list_files(f"file://{tmp_path}")} == {"README.md", "data/test.jsonl", "data/train.jsonl"}


def test_downloads(tmp_path):
    calls = []

    def fetch(url, target):
        calls.append(url)
        with zipfile.ZipFile(target, "w") if url.endswith(".zip") else gzip.open(target, "wb") as f:
            f.writestr("in.txt", "x") if url.endswith(".zip") else f.write(b"x")

    m = DownloadManager(str(tmp_path / "c"), fetch)
    paths = m.download_many(["u/a.zip", "u/b.txt.gz"])
    m.download("u/a.zip")
    assert len(calls) == 2
    assert os.listdir(m.extract(paths[0])) == ["in.txt"] and open(m.extract(paths[1])).read() == "x"


class Small(builder.DatasetBuilder):
    def info(self):
        return builder.DatasetInfo(license="MIT")

    def configs(self):
        return [builder.BuilderConfig("small"), builder.BuilderConfig("large", options={"n": 5})]

    def split_generators(self, downloads, config):
        n = config.options.get("n", 3)
        return [builder.SplitGenerator("train", {"n": n}), builder.SplitGenerator("test", {"n": 2})]

    def generate_examples(self, spark, options):
        return spark.range(options["n"]) if options["n"] == 5 else [(i, {"x": i}) for i in range(options["n"])]


def test_builder(spark):
    assert builder.build(spark, Small()).num_rows == {"test": 2, "train": 3}
    assert len(builder.build(spark, Small(), "large", "train")) == 5
    for bad in ({"config": "huge"}, {"split": "dev"}):
        with pytest.raises(KeyError):
            builder.build(spark, Small(), **bad)


def test_hub(spark, tmp_path):
    client = hub.FolderClient(str(tmp_path / "hub"))
    d = Dataset.from_list(spark, [{"x": i, "text": "y" * 1000} for i in range(100)])
    paths = hub.push(d, "me/data", client, max_shard_bytes=50_000)
    assert len(paths) > 1 and paths[0] == hub.shard_name("default", "train", 0, len(paths)) and "Rows: 100" in (tmp_path / "hub/me/data/README.md").read_text()
    back = load_dataset(spark, "me/data", split="train", source=hub.HubSource(client, str(tmp_path / "cache")))
    assert [r["x"] for r in rows(back)] == list(range(100))
    assert len(hub.delete("me/data", client, "default")) == len(paths) and client.list_files("me/data") == ["README.md"]


def test_catalogue(spark):
    assert len(registry.list_available()) == 24 and registry.list_by_domain("code") == ["deepcoder", "humaneval"]
    assert registry.search("grade SCHOOL") == ["gsm8k"] and registry.list_by_tag("stem") == ["mmlu", "mmlu_stem"]
    assert registry.as_frame(spark).count() == 24 and "24 datasets" in registry.summary()
    with pytest.raises(KeyError):
        registry.get_metadata("nope")


def test_named_loading(spark, tmp_path):
    client = hub.FolderClient(str(tmp_path))
    (tmp_path / "openai/gsm8k/main").mkdir(parents=True)
    (tmp_path / "openai/gsm8k/main/train.jsonl").write_text('{"question": "q", "answer": "<<1>> #### 1,234"}\n{"question": "r", "answer": null}\n')
    d = loader.load(spark, "gsm8k", hub.HubSource(client, str(tmp_path / "c")))
    got = rows(d)
    assert got[0]["id"] == "gsm8k_0" and got[0]["expected"]["answer"] == 1234.0 and got[1]["metadata"] == {"complexity": 1, "difficulty": "easy"}
    assert d.metadata["license"] == "MIT" and d.metadata["config"] == "main"
    (tmp_path / "openai/gsm8k/hard").mkdir()
    (tmp_path / "openai/gsm8k/hard/train.jsonl").write_text('{"question": "h", "answer": "#### 5"}\n')
    (tmp_path / "openai/gsm8k/default").mkdir()
    (tmp_path / "openai/gsm8k/default/train.jsonl").write_text('{"question": "d", "answer": "#### 6"}\n')
    assert len(loader.load(spark, "gsm8k", hub.HubSource(client, str(tmp_path / "c")))) == 2  # the catalogue's, not the repository's own choice
    assert rows(loader.load(spark, "gsm8k", hub.HubSource(client, str(tmp_path / "c")), config="hard"))[0]["expected"]["answer"] == 5.0
    (tmp_path / "nvidia/HelpSteer3/data").mkdir(parents=True)
    (tmp_path / "nvidia/HelpSteer3/data/train.jsonl").write_text("{}\n")
    with pytest.raises(KeyError, match="no configuration"):
        loader.load(spark, "helpsteer3", hub.HubSource(client, str(tmp_path / "c")))
    text = '{"question": "q", "answer": "#### 7"}\noops\n{"question": "z", "answer": "x"}'
    from sparkset.functions import shapes

    made = loader.parse_jsonl_text(spark, text, "question string, answer string", shapes.grade_school_math)
    assert [r["id"] for r in rows(made)] == ["gsm8k_0", "gsm8k_2"]


def test_lazy_pipelines(spark):
    seen = []

    def make():
        for i in range(1000):
            seen.append(i)
            yield {"x": i}

    lazy = IterableDataset.from_generator(make).filter(lambda r: r["x"] % 2 == 1).map(lambda r: r["x"] * 10)
    assert seen == [] and lazy.take(3) == [10, 30, 50] and len(seen) <= 7
    assert IterableDataset.from_generator(make).batch(400).skip(1).take(1)[0][0] == {"x": 400}
    order = IterableDataset.from_generator(make).shuffle(50, seed=1)
    one = order.to_list()
    assert one == order.to_list() and sorted(r["x"] for r in one) == list(range(1000)) and all(r["x"] <= i + 50 for i, r in enumerate(one))
    with pytest.raises(ValueError):
        order.shuffle(0)
    d = IterableDataset.from_dataset(Dataset.from_list(spark, [{"x": i} for i in range(10)])).filter(F.col("x") > 3)
    assert [r["x"] for r in d.skip(1).take(2)] == [5, 6] and len(d.to_dataset()) == 6
    assert d.map(lambda r: {"y": r["x"]}).to_dataset(schema="y long").to_list()[0] == {"y": 4}


def test_streams(spark, tmp_path):
    spark.range(10).write.parquet(f"file://{tmp_path}/in")
    got = []
    s = IterableDataset.read_files(spark, "parquet", f"file://{tmp_path}/in", "id long").filter(F.col("id") >= 4)
    s.start_batches(4, lambda df, _: got.extend((r["batch"], r["id"]) for r in df.collect()), f"file://{tmp_path}/state").awaitTermination()
    assert sorted(i for _, i in got) == list(range(4, 10)) and {b for b, _ in got} == {0, 1}
    with pytest.raises(TypeError):
        s.skip(1)


def test_http_hub(spark, tmp_path):
    """The HTTP interface, spoken by a server in this process: pages of listings, revisions, tokens, commits, redirects."""
    import base64
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import unquote

    from sparkset.sources.http_hub import HttpClient, HubError

    store, seen = {"main": {}, "v1": {"data/train.jsonl": b'{"a": 1}\n', "data/test.jsonl": b'{"a": 2}\n', "README.md": b"x"}}, []

    class Hub(BaseHTTPRequestHandler):
        def answer(self, status, body=b"{}", **headers):
            self.send_response(status)
            for k, v in ({"Content-Length": str(len(body))} | headers).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            seen.append((self.path, self.headers.get("Authorization")))
            path, _, query = self.path.partition("?")
            parts = [unquote(p) for p in path.strip("/").split("/")]
            if "me/data" not in unquote(path) and parts[0] != "cdn":
                return self.answer(404)
            if parts[0] == "cdn":
                return self.answer(200, store[parts[1]]["/".join(parts[2:])])
            if parts[0] == "datasets":  # downloads are sent on
                return self.answer(302, Location=f"http://localhost:{self.server.server_port}/cdn/{parts[4]}/{'/'.join(parts[5:])}")
            files = [{"type": "file", "path": p, "size": len(b)} for p, b in sorted(store[parts[5]].items())]
            if parts[4] == "revision":
                return self.answer(200, json.dumps({"id": "me/data", "cardData": {"configs": [{"config_name": "one"}] if parts[5] == "main" else None}}).encode())
            at = int(query.split("cursor=")[1]) if "cursor=" in query else 0
            more = {"Link": f'<http://127.0.0.1:{self.server.server_port}{path}?cursor={at + 2}>; rel="next"'} if at + 2 < len(files) else {}
            self.answer(200, json.dumps([*files[at : at + 2], {"type": "directory", "path": "data"}]).encode(), **more)

        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization")))
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path.endswith("/create"):
                return self.answer(409)
            operation = json.loads(body.split(b"\n")[1])
            value = operation["value"]
            if operation["key"] == "file":
                store["main"][value["path"]] = base64.b64decode(value["content"])
            else:
                del store["main"][value["path"]]
            self.answer(200)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Hub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = HttpClient(f"http://127.0.0.1:{server.server_port}", token="secret")
        names = hub.push(Dataset.from_list(spark, [{"a": i} for i in range(5)]), "me/data", client)
        assert names == ["default/train/data-00000-of-00001.parquet"] and client.configs("me/data") == ["one"]
        source = hub.HubSource(client, str(tmp_path))
        assert source.exists("me/data") and not source.exists("you/none")
        assert sorted(r["a"] for r in load_dataset(spark, "me/data", split="train", source=source).to_list()) == list(range(5))
        old = load_dataset(spark, "me/data", source=source, revision="v1", token="other")
        assert {k: [r["a"] for r in d.to_list()] for k, d in old.items()} == {"train": [1], "test": [2]}
        v1 = HttpClient(client.endpoint, "v1")
        assert v1.configs("me/data") == ["default"] and b"".join(v1.stream("me/data", "data/test.jsonl", 3)) == b'{"a": 2}\n'
        assert hub.delete("me/data", client, "default") == names and client.list_files("me/data") == ["README.md"]
        with pytest.raises(HubError, match="404"):
            client.info("you/none")
        assert ("Bearer other" in {t for p, t in seen if "v1" in p}) and all(t is None for p, t in seen if p.startswith("/cdn"))
    finally:
        server.shutdown()


def test_arrow_shards(spark, tmp_path):
    d = Dataset.from_list(spark, [{"a": i, "b": [str(i)] if i % 3 else None} for i in range(50)]).sort("a", "desc")
    d.to_arrow(str(tmp_path / "shards"), compression="zstd", sharded=True)
    names = sorted(os.listdir(tmp_path / "shards"))
    assert names and all(n.startswith("part-") and n.endswith(".arrow") for n in names)
    back = from_arrow(spark, [str(tmp_path / "shards" / n) for n in names])
    assert back.to_list() == d.to_list()
