"""Behaviour that changed between versions of the query language."""

from __future__ import annotations

from dataclasses import dataclass

from docweave.errors import ConfigurationError


@dataclass(frozen=True)
class CompatProfile:
    """Which of the version-dependent rules hold; given to the compilers."""

    version: str = "4.2"
    #: MinKey and MaxKey compare with values of any type.
    extremes_compare_all: bool = True
    #: Flags may stand in a regex and in ``$options`` at once.
    regex_flags_twice: bool = False
    #: A remainder of ``$mod`` that is no number is an error, else 0.
    strict_remainder: bool = True
    #: ``$not`` takes ``{"$regex": ...}``.
    not_takes_regex: bool = True
    #: ``$push`` cuts with ``$slice`` before it sorts (else after).
    slice_before_sort: bool = True

    @classmethod
    def of(cls, version: str) -> CompatProfile:
        major = version[:3]
        if major == "3.6" or version.startswith("3."):
            return cls(version, extremes_compare_all=False, regex_flags_twice=True, strict_remainder=False, not_takes_regex=False)
        if major == "4.0":
            return cls(version, regex_flags_twice=True, strict_remainder=False)
        if major == "4.2":
            return cls(version)
        if major == "4.4":
            return cls(version, regex_flags_twice=True)
        raise ConfigurationError(f"unknown version {version!r}; known are 3.6, 4.0, 4.2 and 4.4")


DEFAULT = CompatProfile()
