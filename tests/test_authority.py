import json

import pytest

from factloom.sources.authority import Rejection, admit, normalise_path, read


def document(**fields):
    return json.dumps({"schema_version": 4} | fields)


@pytest.mark.parametrize(
    "raw,code",
    [
        ("{", "authority.syntax"), ("[]", "authority.syntax"), ('{"schema_version": 3}', "authority.version"), (document(extra=1), "authority.syntax"),
        ('{"schema_version": 4, "schema_version": 4}', "authority.syntax"), (document(header_languages={"a.h": "rust"}), "authority.header_language"),
        (document(header_languages={"a/b.h": "c", "a\\b.h": "c"}), "authority.path"), (document(quantity_concepts={"Distance": ["m"]}), "authority.quantity"),
        (document(quantity_concepts={"distance": []}), "authority.quantity"), (document(quantity_concepts={"distance": ["m", "m"]}), "authority.quantity"),
        (document(quantity_concepts={"a": ["b_c"], "a_b": ["c"]}), "authority.quantity"), (document(quantity_concepts={"distance": ["2m"]}), "authority.quantity"),
        (document(dependency_authority={"python_standard_library": ["os"], "python_third_party": ["os"]}), "authority.dependency"),
        (document(dependency_authority={"python_standard_library": ["class"]}), "authority.dependency"), (document(dependency_authority={"python_standard_library": ["a.b"]}), "authority.dependency"),
        (document(external_fixed_identifiers=[{"profile": "c", "role": "function", "owner": "a", "spelling": "b"}]), "authority.external_fixed"),
        (document(external_fixed_identifiers=[{"profile": "rust", "role": "function", "owner": "fmt::type", "spelling": "b"}]), "authority.external_fixed"),
    ],
)
def test_rejected(raw, code):
    with pytest.raises(Rejection) as e:
        admit(raw)
    assert e.value.code == code


def test_admitted_sets_are_order_insensitive():
    a = admit(document(token_vocabulary=["b", "A"], dependency_authority=None, quantity_concepts={"acceleration": ["m_per_s2"]}))
    assert a == admit(document(token_vocabulary=["a", "b"], dependency_authority={}, quantity_concepts={"acceleration": ["m_per_s2"]}))
    assert a.canonical() != admit(document(token_vocabulary=["a"])).canonical()


def test_reading(tmp_path):
    with pytest.raises(Rejection, match="missing") as e:
        read(str(tmp_path))
    assert e.value.code == "authority.read"
    (tmp_path / "authority.json").mkdir()
    with pytest.raises(Rejection, match="cannot be read"):
        read(str(tmp_path))


@pytest.mark.parametrize("path", ["", "/a", "C:/a", "a//b", "./a", "a/../b", "a/."])
def test_bad_paths(path):
    with pytest.raises(Rejection):
        normalise_path(path)
