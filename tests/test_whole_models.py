"""The registered searches are whole, and the final boosted model is registered."""

import pytest

from cityloom.operators import modelling as M
from cityloom.plans import catalog, catalog_model


@pytest.mark.parametrize("kind", sorted(M.SEARCH_SPACE))
def test_searches_take_all_ranges_draws_and_folds(monkeypatch, kind):
    calls = []
    monkeypatch.setattr(catalog_model, "model_rows", lambda t: None)
    monkeypatch.setattr(catalog_model.F, "col", lambda name: name)
    monkeypatch.setattr(M, "random_search", lambda *a, **k: calls.append((a[4], k)))
    catalog.QUERIES["L21_random_search" if kind == "ridge" else f"L21_random_search_{kind}"](None, "")
    assert calls == [(kind, {})] and len(M.SEARCH_SPACE[kind]) and M.SEARCH_DRAWS[kind] >= 20


def test_final_boosted_model_is_registered(monkeypatch):
    calls = []
    monkeypatch.setattr(catalog_model, "holdout", lambda t, name, *a: calls.append(M.FINAL_MODELS[name]))
    catalog.QUERIES["L19_boosted_trees_full"](None, "")
    assert calls[0][0] == "boosted_trees" and (calls[0][2]["trees"], calls[0][2]["depth"]) == (266, 17)
