"""Frozen parameter objects, one per analysis (the reference's hand-edited
placeholders and one-column parameter tables)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class OpportunitySpec:
    """One block of the opportunity screening template."""
    name: str
    type: str
    category: str                 # charge-code cost driver of interest
    keywords: tuple[str, ...]     # description fragments, OR-ed LIKE '%k%'


@dataclass(frozen=True)
class RedundancyParams:
    cpt_codes: tuple[str, ...]
    cost_drivers: tuple[str, ...]
    fiscal_year: int
    patient_settings: tuple[str, ...] = ("Inpatient",)
    source_category_id: int = 1
    # test-complexity ranking: cpt code -> 'A', 'B', ...; others are 'NA'
    ranks: tuple[tuple[str, str], ...] = ()
    # adjacency key: encounter_id, or record_number as the reference compares
    key: str = "encounter_id"


@dataclass(frozen=True)
class EntityCompareParams:
    fiscal_years: tuple[int, ...]
    source_category_id: int = 1
    min_group_vdc: float = 10000.0     # HAVING sum(VDC) > 10000
    worklist_size: int | None = None   # the work list's top N; None: every group is compared
    band: str = "0.05"                 # +/- utilisation band
    excluded_drivers: tuple[str, ...] = ("Excluded", "")


@dataclass(frozen=True)
class QualityParams:
    fiscal_year: int
    qvi_names: tuple[str, ...]
    population: tuple[str, ...]
    population_kind: str = "ctf"          # 'ctf' or 'indicator'
    procedure_cpts: tuple[str, ...] = ()
    source_category_name: str = "Hospital Billing"
    inpatient_settings: tuple[str, ...] = ("Inpatient", "IP")
    control_label: str = "Control"
    excluded_driver: str = "Excluded"
    critical_value: str = "3.841"


@dataclass(frozen=True)
class CohortCriteria:
    """Peer-cohort criteria of the cross-client benchmark (OR-ed)."""
    source_category: str
    patient_setting: tuple[str, ...]
    discharge_year: int
    clienttype: str | None = None
    censusregion: str | None = None
    client_opex: str | None = None
    entitytype: str | None = None
    entity_opex: str | None = None
    bedsize: str | None = None
    coi_pattern: str = "%"
    entities_of_interest: tuple[tuple[int, str], ...] = ()
    cpt_code: str = ""


@dataclass(frozen=True)
class DonorCohortParams:
    min_age: float = 18
    min_year: int = 2002
    min_donor_age: float = 10
    other_organs: tuple[str, ...] = ("tx_hrt", "tx_kid", "tx_lng", "tx_int", "tx_pan")
    extra: dict = field(default_factory=dict)
