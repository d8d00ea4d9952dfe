"""Guard settings, resolved on the driver while the plan is built."""

from __future__ import annotations

from dataclasses import dataclass

from parapet import lexicon


@dataclass(frozen=True)
class GuardConfig:
    """Settings of the input and output guards.

    ``injection_patterns`` are case-insensitive substrings tried in order.
    ``hallucination_threshold`` is the grounding score below which a response is marked.
    ``toxicity_threshold`` is the overall score from which a text counts as toxic.
    """

    injection_patterns: tuple[str, ...] = lexicon.INJECTION_PHRASES
    hallucination_threshold: float = lexicon.GROUNDING_THRESHOLD
    toxicity_threshold: float = lexicon.TOXICITY_THRESHOLD

    @classmethod
    def of(cls, settings: GuardConfig | dict | None) -> GuardConfig:
        """Accept a ready config, a flat settings dict, or nothing."""
        if settings is None:
            return cls()
        if isinstance(settings, cls):
            return settings
        known = {k: v for k, v in settings.items() if k in cls.__dataclass_fields__}
        if "injection_patterns" in known:
            known["injection_patterns"] = tuple(known["injection_patterns"])
        return cls(**known)
