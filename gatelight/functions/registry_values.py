"""The required checks of each evidence level, in order, and who must review them."""

from __future__ import annotations

from dataclasses import dataclass

FAMILIES = ("validity", "substantive", "precision")

LEVELS = {
    "L0": {
        "validity": ["boundary_declared", "recorded_sequence_identified", "integration_method_declared"],
        "substantive": ["numerical_stability_statement"],
        "precision": ["integration_sensitivity_reported"],
    },
    "L1": {
        "validity": ["boundary_declared", "required_gate_set_complete", "runtime_provenance_status", "design_integrity", "mapping_period_separability",
                     "serial_dependence_assessed", "continuous_duration", "telemetry_gap", "endpoint_bracketing", "integration_stability"],
        "substantive": ["functional_unit_declared", "fixed_work_unit", "benefit_threshold"],
        "precision": ["interval_rule", "dependence_compatible_interval", "block_replication", "directional_agreement"],
    },
    "L2": {
        "validity": ["boundary_declared", "required_gate_set_complete", "runtime_provenance_status", "design_integrity", "serial_dependence_assessed",
                     "external_device_calibration", "meter_synchronization", "trace_completeness"],
        "substantive": ["functional_unit_declared", "paired_task_quality", "benefit_threshold"],
        "precision": ["interval_rule", "dependence_compatible_interval", "block_replication", "directional_agreement"],
    },
    "L3": {
        "validity": ["boundary_declared", "required_gate_set_complete", "runtime_provenance_status", "design_integrity", "serial_dependence_assessed",
                     "whole_server_metering", "meter_synchronization", "trace_completeness"],
        "substantive": ["functional_unit_declared", "paired_task_quality", "sla_feasibility", "benefit_threshold"],
        "precision": ["interval_rule", "dependence_compatible_interval", "block_replication", "directional_agreement"],
    },
    "L4": {
        "validity": ["boundary_declared", "required_gate_set_complete", "runtime_provenance_status", "design_integrity", "serial_dependence_assessed",
                     "facility_or_site_boundary", "site_signal_provenance", "observed_arrival_and_eligibility", "queue_log_integrity"],
        "substantive": ["functional_unit_declared", "paired_task_quality", "sla_feasibility", "feasible_operational_policy", "attribution_boundary", "benefit_threshold"],
        "precision": ["interval_rule", "dependence_compatible_interval", "block_replication", "directional_agreement"],
    },
}

ROLES = {
    "validity.*": "measurement_assurance_reviewer",
    "substantive.*": "service_owner_reviewer",
    "precision.*": "statistical_reviewer",
    "validity.external_device_calibration": "metrology_reviewer",
    "validity.whole_server_metering": "metrology_reviewer",
    "validity.facility_or_site_boundary": "operations_reviewer",
    "validity.site_signal_provenance": "sustainability_reviewer",
    "validity.queue_log_integrity": "operations_reviewer",
    "substantive.paired_task_quality": "service_owner_reviewer",
    "substantive.sla_feasibility": "operations_reviewer",
    "substantive.feasible_operational_policy": "operations_reviewer",
    "substantive.attribution_boundary": "sustainability_reviewer",
}

MAX_REVIEW_AGE_DAYS = 365

STATES = {
    "not_assessable": "not_assessable_with_available_evidence",
    "failed": "attested_criterion_failed_under_declared_boundary",
    "inconclusive": "inconclusive_due_to_precision_or_replication",
    "complete": "locally_provenance_complete_evidence_not_independently_validated",
}


@dataclass(frozen=True)
class Registry:
    """The required gates of each level and family, in order, and the roles of reviewers by "family.gate" or "family.*"."""

    levels: dict
    roles: dict

    def __post_init__(self):
        for problem in self.problems():
            raise ValueError(problem)

    def problems(self) -> list[str]:
        """What breaks the contract of a registry."""
        if not isinstance(self.levels, dict):
            return ["the registry has no levels"]
        found = []
        for level, own in self.levels.items():
            if not isinstance(own, dict) or set(own) != set(FAMILIES):
                found.append(f"level {level!r} must have just the families {', '.join(FAMILIES)}")
                continue
            for family, gates in own.items():
                if not isinstance(gates, list) or not gates or not all(isinstance(g, str) and g.strip() for g in gates):
                    found.append(f"level {level!r} needs a list of gate names for {family}")
        return found if isinstance(self.roles, dict) else [*found, "the registry has no roles"]

    def gate_rows(self) -> list[tuple[str, str, int, str, int]]:
        """(level, family, place of the family, gate, place of the gate)."""
        return [(level, family, f, gate, g) for level, own in self.levels.items() for f, family in enumerate(FAMILIES) for g, gate in enumerate(own[family])]


PUBLISHED = Registry(LEVELS, ROLES)


def gate_rows() -> list[tuple[str, str, int, str, int]]:
    return PUBLISHED.gate_rows()
