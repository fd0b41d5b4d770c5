import inspect
import math

from gatelight import registry
from gatelight.operators import simulate as S


def test_composite_null_meets_closed_forms(spark):
    rows = {(r.scenario, r.effect): r for r in S.composite_null(spark, 4000).collect()}
    assert len(rows) == 17 and all(r.iterations == 4000 for r in rows.values())
    for effect, rate in ((0.0, 0.1030), (2.0, 0.5), (5.0, 0.9711)):
        assert abs(rows["iid_normal", effect].b0_rate - rate) < 0.03
    for effect, rate in ((0.0, 0.0547), (2.0, 0.2735), (5.0, 0.7973)):
        assert abs(rows["iid_normal", effect].guard_rate - rate) < 0.03
    assert abs(rows["iid_normal", 2.0].b1_rate - 0.05) < 0.015
    assert all((r.power == 0) == (r.effect <= 2.0) or r.b2_rate == 0 for r in rows.values())


def test_ar1_control_covers(spark):
    rows = {r.effect: r for r in S.ar1_control(spark, 1500).collect()}
    assert all(abs(r.lower_coverage - 0.95) < 0.025 and abs(r.upper_coverage - 0.95) < 0.025 for r in rows.values())
    assert abs(rows[5.0].exact_se - 0.87973) < 1e-4


def test_stress_and_attestation(spark):
    rows = {r.scenario: r for r in S.stress(spark, 500).collect()}
    assert len(rows) == 5 and all(r.inconclusive_probability == 1.0 for r in rows.values() if not r.compatible)
    found = S.attestation_error(spark, 5000).collect()
    assert len(found) == 9 and all(r.abstention_rate == 1.0 for r in found if not r.local_checks_pass)
    assert all(abs(r.false_promotion_rate - r.error_rate) < 0.02 for r in found if "false_pass" in r.scenario)


def test_registered_simulations_draw_as_often_as_the_reference(spark):
    for simulate in (S.composite_null, S.direction_guard, S.ar1_control, S.stress, S.attestation_error):
        assert inspect.signature(simulate).parameters["n_iter"].default == 100_000
    assert {r.iterations for r in registry.STUDIES["sim_attestation_error"](spark, "").collect()} == {100_000}


def test_ar1_control_has_error_and_power_rates(spark):
    for r in S.ar1_control(spark, 200).collect():
        wanted = (0.0, r.contradicted_rate, r.supported_rate) if r.effect > S.SESOI else (r.supported_rate, 0.0, 0.0)
        assert (r.false_support_rate, r.false_contradiction_rate, r.power_supported_rate) == wanted


def test_direction_guard_meets_closed_forms(spark):
    rows = {(r.design, r.n_blocks, r.effect): r for r in S.direction_guard(spark, 2000).collect()}
    assert len(rows) == 30
    above = {0.0: 0.5, 2.0: 0.655422, 5.0: 0.841345}  # chance that a block with standard deviation 5 is favorable
    for n in (10, 20, 35, 50):
        needed = -(-8 * n // 10)
        for effect, p in above.items():
            exact = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(needed, n + 1))
            assert abs(rows["iid_normal", n, effect].guard_rate - exact) < 0.045, (n, effect)
        for design in ("iid_normal", "ar1_oracle_interval"):
            assert abs(rows[design, n, 2.0].ci_support_rate - 0.05) < 0.022, (design, n)
    for r in rows.values():
        assert abs(r.joint_rate + r.support_guard_fail_rate - r.ci_support_rate) < 1e-12 and r.joint_rate <= r.guard_rate
