import pyarrow.parquet as pq


def table(sf_dir, name):
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def documents(sf_dir):
    return [(r["doc_id"], r["text"]) for r in table(sf_dir, "documents")]
