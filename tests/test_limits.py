"""Notebooks have a size limit of their own."""

from grantscope.sources import configs


def test_notebooks_are_read_up_to_their_own_limit(spark, tmp_path):
    mib = 1024 * 1024
    for name, size in (("a.ipynb", 6 * mib), ("b.ipynb", 25 * mib + 1), ("c.json", 5 * mib), ("d.json", 5 * mib + 1)):
        (tmp_path / name).write_bytes(b" " * size)
    found = {r.path.rsplit("/", 1)[1]: (r.diagnostic, r.n) for r in configs.read_files(spark, str(tmp_path)).selectExpr("path", "diagnostic", "length(text) as n").collect()}
    assert found == {"a.ipynb": (None, 6 * mib), "b.ipynb": ("file_too_large", None), "c.json": (None, 5 * mib), "d.json": ("file_too_large", None)}
