"""The label ontology: plain configuration, small by nature, held on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Mapping, Sequence

# Label names, descriptions, allowed pairs and the no-relation bullet.
DEFAULT_ENTITIES = {
    "Problem": "Health issues including diseases, symptoms, disorders, or injuries",
    "Treatment": "Medical interventions including medications, surgeries, therapies, or devices",
    "Test": "Clinical measurements including lab tests, imaging studies, or examinations",
}
DEFAULT_RELATIONS = {
    "TrIP": "Treatment Improves Problem",
    "TrWP": "Treatment Worsens Problem",
    "TrCP": "Treatment Causes Problem",
    "TrAP": "Treatment Administered for Problem",
    "TrNAP": "Treatment Not Administered because of Problem",
    "TeRP": "Test Reveals Problem",
    "TeCP": "Test Conducted because of Problem",
    "PIP": "Problem Indicates Problem",
}
DEFAULT_PAIRS = (("Treatment", "Problem"), ("Test", "Problem"), ("Problem", "Problem"))
NO_RELATION = "NONE"
NO_RELATION_BULLET = "- NONE: No valid clinical relation exists between the entities"


@dataclass(frozen=True)
class Ontology:
    """Entity labels, relation labels (both in display order) and the allowed (subject, object) label pairs."""

    entities: Mapping[str, str]
    relations: Mapping[str, str]
    valid_pairs: Sequence[tuple[str, str]]

    @classmethod
    def default(cls) -> "Ontology":
        return cls(dict(DEFAULT_ENTITIES), dict(DEFAULT_RELATIONS), DEFAULT_PAIRS)

    def objects_by_subject(self) -> dict[str, list[str]]:
        """Allowed object labels of each subject label."""
        allowed: dict[str, list[str]] = {}
        for subject, obj in dict.fromkeys((p[0], p[1]) for p in self.valid_pairs):
            allowed.setdefault(subject, []).append(obj)
        return allowed

    def entity_bullets(self) -> str:
        return "\n".join(f"- {label}: {text}" for label, text in self.entities.items())

    def relation_bullets(self) -> str:
        bullets = [f"- {label}: {text}" for label, text in self.relations.items()]
        return "\n".join([*bullets, NO_RELATION_BULLET])
