from siftwood.index import Index
from siftwood.operators import hybrid as H


def index(spark, folder):
    tables = {
        "files": ([(i, f"src/f{i}.go", "go", 1, "h", "2024") for i in range(1, 5)], "file_id long, rel_path string, lang string, size long, hash string, indexed_at string"),
        "chunks": ([(1, 1, 1, 5, "session cache here"), (1, 1, 1, 5, "session cache here"), (2, 2, 1, 5, "a cache"), (3, 3, 1, 5, "nothing"), (4, 4, 1, 5, "else")], "chunk_id long, file_id long, start_line int, end_line int, text string"),
        "symbols": ([(1, 3, "f", "function", None, 2, 3, None, None, "keeps the session cache"), (2, 4, "g", "function", None, 9, 9, None, None, "session cache, outside of every chunk")], "symbol_id long, file_id long, name string, kind string, signature string, start_line int, end_line int, parent_id long, complexity int, doc string"),
        "edges": ([], "edge_id long, src_type string, src_id long, kind string, file_id long, line int, raw string, dst_type string, dst_id long, resolved boolean"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Index(spark, str(folder))


def test_words_vectors_and_docs_together(spark, tmp_path):
    made = index(spark, tmp_path)
    order = lambda df: [r.chunk_id for r in df.orderBy("position").collect()]
    assert order(H.plain_search(made, "session cache")) == [1, 2, 3]  # chunk 3 by its documentation only
    vectors = spark.createDataFrame([(2, [1.0, 0.1]), (4, [0.9, 0.0]), (3, [0.0, 1.0]), (77, [1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(-1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    # 2 is in both lists; 1 leads by words, 4 and 3 follow by vectors; 77 is no chunk
    assert order(H.hybrid_search(made, "session cache", vectors, asked)) == [2, 1, 4, 3]
    assert order(H.hybrid_search(made, "session cache", vectors, asked.limit(0))) == [1, 2, 3]
    assert order(H.hybrid_search(made, "no such words")) == []
