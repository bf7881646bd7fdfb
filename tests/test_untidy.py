"""Folders whose files differ in separator, encoding, header and depth."""

import json

from ledgerloom.sources import untidy


def test_a_folder_of_three_dialects_and_three_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'Statement of XX99\n\nTxn Date,Narration,Amount\n01/03/2024,"Shop, the ""old"" one","1,200.00"\n02/03/2024,Back,50.00 Cr\n,no day,1.00\n')
    (tmp_path / "b.txt").write_bytes("Datum;x\nDate;Details;Debit;Credit\n03/03/2024;Café;10.50;\n04/03/2024;Zurück;;7.00\n".encode("latin-1"))
    (tmp_path / "c.tsv").write_bytes("Transaction Date\tDescription\tDr/Cr\tAmount\r\n05/03/2024\tNaïve\tCR\t3.00\r\n06/03/2024\tPlain\tDR\t4.00".encode("utf-16"))
    (tmp_path / "d.csv").write_bytes(b"only,prose\nand,more\n")
    (tmp_path / "e.csv").write_bytes(b"\n")
    (tmp_path / "f.csv").write_bytes(b"Date|Particulars|Withdrawal|Deposit\n")
    rows, files = untidy.card_exports(spark, str(tmp_path))
    got = {(r["file"][-5:], str(r["day"])[5:], r["details"], r["cents"], r["credit"]) for r in rows.collect()}
    assert got == {
        ("a.csv", "03-01", 'Shop, the "old" one', 120000, False), ("a.csv", "03-02", "Back", 5000, True), ("b.txt", "03-03", "Café", 1050, False), ("b.txt", "03-04", "Zurück", 700, True),
        ("c.tsv", "03-05", "Naïve", 300, True), ("c.tsv", "03-06", "Plain", 400, False),
    }
    told = {r["file"][-5:]: (r["state"], r["header"], r["rows"]) for r in files.collect()}
    assert told == {"a.csv": ("read", 2, 2), "b.txt": ("read", 1, 2), "c.tsv": ("read", 0, 2), "d.csv": ("no header", None, 0), "e.csv": ("no header", None, 0), "f.csv": ("read", 0, 0)}


def test_lists_of_objects_at_any_depth(spark, tmp_path):
    item = lambda n, **more: {"Time": f"t{n}", "amount": n} | more
    files = {
        "flat.json": json.dumps([item(1), {"when": "w2", "time": None}]),
        "deep.json": json.dumps({"meta": {"n": [1, 2]}, "data": {"inner": {"list": [item(3)]}, "z": {"list": [item(9)]}}}),
        "guard.json": ")]}'\n" + json.dumps({"x": {"items": [item(4), {"other": 1}]}}),
        "lines.json": json.dumps(item(5)) + "\n" + json.dumps(item(6)) + "\nnot json",
        "one.json": json.dumps(item(7)), "none.json": "prose", "empty.json": "", "numbers.json": "[1, 2]",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = untidy.json_objects(spark, str(tmp_path), {"at": ["time", "when"], "sum": ["amount"]}).collect()
    assert sorted((r["file"].split("/")[-1], r["item"], r["at"], r["sum"]) for r in got) == [
        ("deep.json", 0, "t3", "3"), ("flat.json", 0, "t1", "1"), ("flat.json", 1, "w2", None), ("guard.json", 0, "t4", "4"), ("lines.json", 0, "t5", "5"), ("lines.json", 1, "t6", "6"), ("one.json", 0, "t7", "7")]
