import pytest

from palimpsest.spec import FieldSpec, Precondition, SpecError, TableSpec, check_successor, differences, evolve, migrate, normalize_records

V1 = TableSpec("m", ("user_id",), (FieldSpec(1, "user_id", "string", False), FieldSpec(2, "count", "int64", False, 0), FieldSpec(3, "active", "bool")))


def changed(*fields, version=2):
    return TableSpec("m", ("user_id",), fields, version)


@pytest.mark.parametrize("fields", [
    (), (FieldSpec(0, "a", "int64"),), (FieldSpec(1, " ", "int64"),), (FieldSpec(1, "a", "int64"), FieldSpec(1, "b", "int64")),
    (FieldSpec(1, "a", "int64"), FieldSpec(2, "a", "int64")), (FieldSpec(1, "a", "int64", True, "x"),), (FieldSpec(1, "a", "int64", True, True),), (FieldSpec(1, "a", "date"),),
])
def test_invalid(fields):
    with pytest.raises(SpecError):
        changed(*fields).check()


def test_successors():
    check_successor(V1, changed(FieldSpec(1, "user", "string", False), FieldSpec(4, "note", "string")))
    for bad in (
        changed(*V1.fields, version=1), changed(FieldSpec(1, "user_id", "int64")), changed(*V1.fields, FieldSpec(4, "x", "int64", False)),
        changed(FieldSpec(9, "count", "int64")),
    ):
        with pytest.raises(SpecError):
            check_successor(V1, bad)


def test_evolve_and_normalize(spark):
    df = spark.createDataFrame([("a", 1, None)], "user_id string, count long, active boolean")
    new = changed(FieldSpec(1, "user", "string", False), FieldSpec(2, "count", "int64", False, 0), FieldSpec(4, "note", "string", False, "-"))
    assert [tuple(r) for r in evolve(df, V1, new).select("user", "count", "note").collect()] == [("a", 1, "-")]
    only = spark.createDataFrame([("a",)], "user_id string")
    assert tuple(normalize_records(only, V1).first()) == ("a", 0, None)
    assert tuple(normalize_records(only, V1, operand=True).first()) == ("a", None, None)
    with pytest.raises(SpecError):
        normalize_records(only.withColumnRenamed("user_id", "other"), V1)


def test_migrations():
    catalog = migrate({}, "ensure", V1, Precondition("missing", "m"))
    assert migrate(catalog, "ensure", V1) == catalog
    both = Precondition("all", parts=(Precondition("exists", "m"), Precondition("not", parts=(Precondition("version", "m", 3),))))
    after = migrate(catalog, "metadata", table="m", metadata={"owner": "x"}, when=both)
    assert Precondition("metadata", "m", ("owner", "x")).holds(after) and differences(V1, after["m"]) == ["metadata"]
    with pytest.raises(SpecError):
        migrate(catalog, "install", changed(*V1.fields), Precondition("any", parts=(Precondition("version", "m", 7),)))
