"""Step files: an ordered list of operations with selections, run on a store."""

from __future__ import annotations

import configparser
import difflib
import inspect
import logging
import re
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from solweave.functions.scalar import quantity
from solweave.model import Solutions
from solweave.operators import cells, fits, flagging, plotting, referencing, smoothing
from solweave.operators import residuals as _residuals
from solweave.sources.store import Store

log_ = logging.getLogger(__name__)

#: Operations by name: (function, how its result is stored).
OPERATIONS: dict[str, Callable[..., object]] = {}


def operation(name: str) -> Callable[[Callable], Callable]:
    """Register an operation: a function of (store, solset, table, **options) that returns tables to write."""

    def add(f: Callable) -> Callable:
        OPERATIONS[name.upper()] = f
        return f

    return add


def parse(text: str) -> dict[str, dict[str, str]]:
    """Sections in order; options before the first one are global (under ``_global``). Options are in lower case, as their case doesn't matter. ``#`` and ``;`` start comments."""
    p = configparser.ConfigParser(inline_comment_prefixes=("#", ";"), interpolation=None, strict=False)
    p.read_string("[_global]\n" + text)
    return {s: dict(p.items(s)) for s in p.sections()}


def words(text: str) -> list[str]:
    """Members of ``[a, b]`` or ``a``."""
    return [w.strip().strip("'\"") for w in text.strip().strip("[]").split(",") if w.strip()]


def value(text: str) -> object:
    """A number, a truth value, a list or the text itself."""
    t = text.strip()
    if t.startswith("["):
        return [value(w) for w in words(t)]
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if t.lower() in ("none", ""):
        return None
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t.strip("'\"")


def selection_of(axis: str, step: dict[str, str], common: dict[str, str]) -> object:
    """The selection of an axis: a step's own before a global one; lists, regular expressions, ranges and steps."""
    axis = axis.lower()
    for options in (step, common):
        if axis in options:
            return value(options[axis])
        if f"{axis}.regexp" in options:
            return options[f"{axis}.regexp"].strip()
        if f"{axis}.minmaxstep" in options:
            got = value(options[f"{axis}.minmaxstep"])
            return dict(zip(("min", "max", "step"), got, strict=False))
    return None


def run(text: str, store: Store) -> list[tuple[str, str, float]]:
    """Run all steps; returns (step, table, seconds). A step that fails is logged and the next one runs."""
    sections = parse(text)
    common, done = sections.pop("_global"), []
    for name, step in sections.items():
        op = OPERATIONS.get(step.get("operation", name).upper())
        if op is None:
            log_.error("unknown operation in step %s: %s", name, step.get("operation"))
            continue
        wanted = words(step.get("soltab", common.get("soltab", "")))
        for address in [f"{s}/{t}" for s in store.solsets() for t in store.tables(s)]:
            if not any(address == w or re.fullmatch(w, address) for w in wanted):
                continue
            began = time.monotonic()
            try:
                solset, table = address.split("/")[0], store.table(address)
                picks = {a: selection_of(a, step, common) for a in table.axes}
                part = cells.duplicate(table, table.name, **{a: p for a, p in picks.items() if p is not None})
                options = _options(op, step, name)
                for out in op(store, solset, part, **options) or []:
                    if out.name == table.name and out.axes == table.axes and any(p is not None for p in picks.values()):
                        out = _merge(table, out)
                    store.write(solset, out, note=f"{step.get('operation', name).upper()} {options}")
                done.append((name, address, time.monotonic() - began))
            except (ValueError, KeyError, RuntimeError) as e:
                log_.error("step %s on %s: %s", name, address, e)
    return done


def _merge(table: Solutions, part: Solutions) -> Solutions:
    """Put the selected cells back among the others."""
    rest = table.df.join(part.df.select(*table.axes), list(table.axes), "left_anti")
    cols = [*table.axes, "val", "weight"]
    return table.put(rest.select(*cols).unionByName(part.df.select(*cols)))


def _options(op: Callable, step: dict[str, str], name: str) -> dict[str, object]:
    known = {p.lower(): p for p in inspect.signature(op).parameters if p not in ("store", "solset", "table")}
    out = {}
    for k, v in step.items():
        if k in ("operation", "soltab") or k.split(".")[0] in ("ant", "pol", "dir", "freq", "time"):
            continue
        if k in known:
            out[known[k]] = value(v)
        else:
            near = difflib.get_close_matches(k, known, 1)
            log_.warning("step %s: unknown option %s%s", name, k, f"; did you mean {known[near[0]]}?" if near else "")
    return out


def _list(x: object) -> list:
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def _pairs(x: object) -> list[tuple[float, float]] | None:
    """Pairs of ``[a, b, a, b]``; none at all for ``equal``."""
    flat = [] if x == "equal" else [float(v) for v in _list(x)]
    return None if x is None else list(zip(flat[::2], flat[1::2], strict=True))


def _sub(store: Store, solset: str, names: object) -> list[Solutions]:
    return [store.table(n if "/" in str(n) else f"{solset}/{n}") for n in _list(names)]


operation("ABS")(lambda store, solset, table: [cells.absolute(table)])
operation("CLIP")(lambda store, solset, table, axesToClip=None, clipLevel=5.0, log=False, mode="median": [cells.clip(table, _list(axesToClip), clipLevel, log, mode)])
operation("NORM")(lambda store, solset, table, axesToNorm=None, normVal=1.0, log=False: [cells.norm(table, _list(axesToNorm), normVal, log)])
operation("RESET")(lambda store, solset, table, dataVal=None: [cells.reset(table, None if dataVal in (None, -999, -999.0) else dataVal)])
operation("DUPLICATE")(lambda store, solset, table, soltabOut=None, overwrite=False: [cells.duplicate(table, str(soltabOut) if overwrite and soltabOut else store.free_name(solset, table.kind, soltabOut))])
operation("DELETEAXIS")(lambda store, solset, table, axisDelete=None, fromCell="first": [cells.delete_axis(table, axisDelete, fromCell)])
operation("REPLICATEONAXIS")(lambda store, solset, table, axisReplicate=None, fromCell="first", updateWeights=False: [cells.replicate_on_axis(table, axisReplicate, fromCell, updateWeights)])
operation("FLAG")(lambda store, solset, table, axesToFlag=None, order=None, maxCycles=5, maxRms=5.0, maxRmsNoise=0.0, fixRms=0.0, fixRmsNoise=0.0, windowNoise=11, replace=False, preflagzeros=False, mode="smooth", refAnt="": [
    _judged(table, flagging.flag(_referenced(store, solset, table, refAnt, "ignore"), _list(axesToFlag), _list(order), maxCycles, maxRms, maxRmsNoise, fixRms, fixRmsNoise, windowNoise, replace, preflagzeros, mode), replace)])
operation("FLAGEXTEND")(lambda store, solset, table, axesToExt=None, size=None, percent=50.0, maxCycles=3: [flagging.extend_flags(table, _list(axesToExt), _list(size), percent, maxCycles)])
operation("SMOOTH")(lambda store, solset, table, axesToSmooth=None, size=None, mode="runningmedian", degree=1, replace=False, log=False, refAnt="": [smoothing.smooth(_referenced(store, solset, table, refAnt, "auto"), _list(axesToSmooth), _list(size), mode, degree, replace, log)])
operation("REFERENCE")(lambda store, solset, table, refAnt="", refDir="", preservePol=False: [referencing.reference(table, _known(table, "ant", refAnt), _known(table, "dir", refDir), store.side(solset, "antenna"), store.side(solset, "source"), bool(preservePol))])
operation("RESIDUALS")(lambda store, solset, table, soltabsToSub=None, ratio=False: [_residuals.residuals(table, _sub(store, solset, soltabsToSub), ratio)])
operation("INTERPOLATE")(lambda store, solset, table, outsoltab=None, axisToRegrid=None, newdelta=None, delta="", maxFlaggedWidth=0, log=False: [
    replace(smoothing.interpolate(table, axisToRegrid, newdelta, delta or "", maxFlaggedWidth, log), name=outsoltab or table.name)])
operation("TEC")(lambda store, solset, table, soltabOut="tec000", refAnt="", maxResidualFlag=2.5, maxResidualProp=1.0, sensitivity=None: [fits.tec(*_fixed(store, solset, table, refAnt), maxResidualFlag, maxResidualProp, _pairs(sensitivity), name=soltabOut)])
operation("FARADAY")(lambda store, solset, table, soltabOut="rotationmeasure000", refAnt="", maxResidual=1.0: [fits.faraday(*_fixed(store, solset, table, refAnt), maxResidual, soltabOut)])


@operation("POLALIGN")
def _polalign(store, solset, table, soltabOut="phasediff", minFreq=0.0, refAnt=""):
    table, name = _fixed(store, solset, table, refAnt)
    return [fits.align_polarisations(referencing.reference(table, name or None), minFreq, name, soltabOut)]


@operation("CLOCKTEC")
def _clocktec(store, solset, table, tecsoltabOut="tec000", clocksoltabOut="clock000", offsetsoltabOut="phase_offset000", tec3rdsoltabOut="tec3rd000", flagBadChannels=True, flagCut=5.0, chi2cut=3000.0, combinePol=False, fit3rdorder=False, removePhaseWraps=True, circular=False, reverse=False, invertOffset=False, nproc=None):
    return list(fits.clock_tec(table, fit3rdorder, combinePol, flagBadChannels, flagCut, chi2cut, (tecsoltabOut, clocksoltabOut, offsetsoltabOut, tec3rdsoltabOut), store.side(solset, "antenna"), removePhaseWraps, circular, reverse, invertOffset).values())


@operation("FLAGSTATION")
def _flagstation(store, solset, table, mode="relative", minFlaggedFraction=0.0, maxFlaggedFraction=0.5, nSigma=5.0, maxStddev=None, ampRange=None, thresholdBaddata=0.5, telescope="lofar", skipInternational=False, skipAnts=None, refAnt="", soltabExport=""):
    cap = maxStddev if maxStddev and maxStddev > 0 else None
    if mode == "resid":
        if refAnt and not table.is_phase:
            log_.warning("only phases are referenced: refAnt is ignored for %s", table.name)
            refAnt = ""
        done = flagging.flag_stations_residual(_referenced(store, solset, table, "closest" if refAnt == "nearest" else refAnt, "first"), minFlaggedFraction, maxFlaggedFraction, nSigma, cap)
        out = table.put(table.df.drop("weight").join(done.df.select(*table.axes, "weight"), list(table.axes)))
    elif mode == "bandpass":
        out = flagging.flag_stations_bandpass(table, cap, maxFlaggedFraction, nSigma, amp_range=_list(ampRange) or None, least=minFlaggedFraction, skip=_list(skipAnts), skip_international=skipInternational, telescope=telescope)
    else:
        out = flagging.flag_stations_relative(table, nSigma, thresholdBaddata, _list(skipAnts), skipInternational)
    more = [flagging.export_station_flags(out, t) for t in _sub(store, solset, soltabExport)] if soltabExport else []
    return [out, *more]


@operation("REWEIGHT")
def _reweight(store, solset, table, mode="uniform", weightVal=1.0, nmedian=3, nstddev=251, soltabImport="", flagBad=False):
    if flagBad:
        table = cells.flag_defaults(table)
    if mode == "copy":
        return [cells.reweight_copy(table, _sub(store, solset, soltabImport)[0])]
    return [smoothing.reweight_window(table, "time", nmedian, nstddev)] if mode == "window" else [cells.reweight_uniform(table, weightVal)]


@operation("INTERPOLATEDIRECTIONS")
def _directions(store, solset, table, interp_dirs=None, soltabOut=None, prefix="interp_"):
    flat = [quantity(x) for x in _list(interp_dirs)]
    out, added = fits.interpolate_directions(table, store.side(solset, "source"), list(zip(flat[::2], flat[1::2], strict=True)), prefix)
    known = store.side(solset, "source")
    rows = known.unionByName(added).collect()  # a few hundred directions
    store.write_side(solset, "source", store.spark.createDataFrame(rows, "name string, dir array<float>"))
    return [out.put(out.df, name=soltabOut or table.name)]


@operation("STRUCTURE")
def _structure(store, solset, table, doUnwrap=False, refAnt="", plotName="", ndiv=1):
    table = _referenced(store, solset, table, refAnt or ("auto" if doUnwrap else ""), "auto")
    pairs = fits.structure_pairs(table, store.side(solset, "antenna"), ndiv=ndiv, unwrap=doUnwrap)
    if plotName:
        pairs.write.mode("overwrite").parquet(f"{store.root}/{solset}/_plots/{plotName}")
    for r in fits.structure_function(pairs).collect():  # a row per part
        store.add_history(solset, table.name, f"STRUCTURE part {r.part}: beta={r.beta:.3f}, R_diff={r.r_diff:.3f} m")
    return []


@operation("PLOT")
def _plot(store, solset, table, axesInPlot=None, axisInTable="", axisInCol="", axisDiff="", NColFig=0, figSize=None, markerSize=2, minmax=None, log="", plotFlag=False, doUnwrap=False, refAnt="", refDir="", soltabsToAdd=None, makeAntPlot=False, makeMovie=False, prefix=""):
    """Points for any tool, under ``_plots``; drawn beside them where matplotlib is at hand. The files are a film's frames, in the order of their names."""
    if soltabsToAdd:
        log_.warning("soltabsToAdd is ignored")
    if makeAntPlot and _list(axesInPlot) != ["ant"]:
        raise ValueError("makeAntPlot needs axesInPlot = [ant]")
    table = _referenced(store, solset, table, refAnt, "auto")
    if refDir:
        names = table.axis_values("dir")
        if refDir != "center" and refDir not in names:
            log_.error("no direction %s: using %s", refDir, names[min(1, len(names) - 1)])
            refDir = names[min(1, len(names) - 1)]
        table = referencing.reference(table, None, refDir, sources=store.side(solset, "source"))
    limits = tuple(float(x) for x in _list(minmax)) or None
    rows = plotting.plot_rows(table, _list(axesInPlot), axisInTable or "", axisInCol or "", axisDiff or "", "Z" in (log or ""), plotFlag, doUnwrap, limits, store.side(solset, "antenna") if makeAntPlot else None)
    path = f"{store.root}/{solset}/_plots/{prefix or 'plot'}-{table.name}"
    rows.write.mode("overwrite").parquet(path)
    kept = store.spark.read.parquet(path)
    try:
        for f in [r.file for r in kept.select("file").distinct().orderBy("file").toLocalIterator()] if "://" not in path else []:
            plotting.render(kept.filter(F.col("file") == f), f"{path}/_{f}.png", _list(figSize) or (0, 0), markerSize, NColFig)
    except RuntimeError as e:
        log_.info("%s", e)
    return []


@operation("LOFARBEAM")
def _beam(store, solset, table):
    from solweave.operators.beam import fill_beam

    return [fill_beam(table)]


def _reference_name(store: Store, solset: str, table: Solutions, ref: str | None, missing: str) -> str | None:
    """The reference to use. One that isn't in the table is ``ignore``d, looked for (``auto``), replaced by the ``first`` antenna, or an ``error``."""
    if not ref or ref in ("auto", "closest", "center") or table.df.filter(F.col("ant") == ref).limit(1).count():
        return ref or None
    if missing == "error":
        raise ValueError(f"{table.name} has no antenna {ref}")
    use = {"ignore": None, "auto": "auto", "first": table.axis_values("ant")[0] if missing == "first" else None}[missing]
    log_.warning("no antenna %s in %s: %s", ref, table.name, f"using {use}" if use else "not referenced")
    return use


def _referenced(store: Store, solset: str, table: Solutions, ref: str | None, missing: str = "error") -> Solutions:
    """The table relative to an antenna; other kinds than phases and what adds up to them, and tables without antennas, stay as they are."""
    if not ref:
        return table
    if "ant" not in table.axes or not (table.is_phase or table.kind in ("tec", "clock", "tec3rd", "rotationmeasure")):
        log_.error("%s can't be referenced to an antenna: not referenced", table.name)
        return table
    ref = _reference_name(store, solset, table, ref, missing)
    return referencing.reference(table, ref, antennas=store.side(solset, "antenna")) if ref else table


def _fixed(store: Store, solset: str, table: Solutions, ref: str | None) -> tuple[Solutions, str]:
    """The table and the name of its reference antenna, looked for unless it is given and there; none after referencing to the closest ones."""
    ref = _reference_name(store, solset, table, ref or "auto", "auto")
    antennas = store.side(solset, "antenna")
    if ref == "closest":
        return referencing.reference(table, ref, antennas=antennas), ""
    if ref == "auto":
        ref = referencing.auto_reference(table, antennas) if antennas is not None else referencing.least_flagged(table)
    return table, ref


def _judged(table: Solutions, flagged: Solutions, replaced: bool) -> Solutions:
    """The flags of values that were referenced for the judgement; the stored values stay unless they were to be replaced."""
    if replaced:
        return flagged
    return table.put(table.df.drop("weight").join(flagged.df.select(*table.axes, "weight"), list(table.axes)))


def _known(table: Solutions, axis: str, ref: str | None) -> str | None:
    """The name of a reference, which has to be in the table unless it is looked for."""
    if ref and ref not in ("auto", "closest", "center") and not table.df.filter(F.col(axis) == ref).limit(1).count():
        raise ValueError(f"{table.name} has no {axis} {ref}")
    return ref or None
