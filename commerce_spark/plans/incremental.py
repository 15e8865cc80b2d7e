"""Incremental ingestion: frozen windows, raw and staged rows, quality gate, atomic publication with watermarks.

A run goes from iniciada over preparada and aprovada to sucesso, or to falha; sucesso is final. Payloads are JSON
objects as text. Tables, watermarks and run states change together, in one version of the store.

Raw and staged rows lie by run, facts by month: a run reads and writes its own partitions and the months that it touches,
whatever the history holds. Every stage logs one JSON line an entity, with the rows that its own job counted.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commerce_spark import registry
from commerce_spark.operators import changes, quality
from commerce_spark.operators.checks import Declared, checked
from commerce_spark.operators.telemetry import stage_event
from commerce_spark.registry import ENTITIES, Entity
from commerce_spark.sources.store import Layout, Store, signature

LOOKBACK = timedelta(minutes=5)
EPOCH = "1970-01-01T00:00:00+00:00"
RAW = "execucao string, entidade string, chave string, versao timestamp, payload string"
RAW_LAYOUT = Layout(("execucao", "entidade"), ("chave", "versao"))


#: Conditions on an entity's rows, by the message of what breaks them; returns stand beside their sale (_q pieces, cancelled _c).
RULES = {
    "clientes": {"UF inválida": "uf rlike '^[A-Z]{2}$'"},
    "vendas": {"quantidade ou valores inválidos": "quantidade > 0 and valor_bruto >= 0 and valor_desconto >= 0 and valor_desconto <= valor_bruto", "líquido divergente": "valor_liquido = valor_bruto - valor_desconto"},
    "metas": {"valor/competência inválido": "valor_meta >= 0 and trunc(competencia, 'MM') = competencia"},
    "devolucoes": {"lançamento sem venda": "_q is not null", "venda cancelada": "_q is null or not _c", "quantidade ou valor inválido": "quantidade > 0 and valor_devolvido > 0", "data ou motivo inválido": "_q is null or (data_devolucao >= data_venda and trim(motivo) <> '')"},
}


class Source(Protocol):
    """What a run reads from: a call that gives the payloads of an entity changed in [low, high)."""

    def __call__(self, entity: str, low: datetime, high: datetime) -> DataFrame: ...


def _instant(text: str) -> datetime:
    at = datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("an instant needs its offset")
    return at.astimezone(timezone.utc)


def lag_hours(marks: DataFrame, now: DataFrame) -> DataFrame:
    """entidade, valor, horas_defasagem: whole hours from each watermark to `agora`, the one value of now."""
    return marks.crossJoin(F.broadcast(now)).select("entidade", "valor", F.timestamp_diff("HOUR", F.col("valor"), F.col("agora")).alias("horas_defasagem"))


class Runs:
    def __init__(self, spark: SparkSession, folder: str, entities: dict[str, Entity] = ENTITIES):
        self.spark, self.store, self.entities = spark, Store(spark, folder), entities

    def _state(self) -> dict:
        return self.store.manifest()["state"]

    def _run(self, run: str, *allowed: str) -> dict:
        found = self._state().get(f"run:{run}")
        if found is None or (allowed and found["status"] not in allowed):
            raise ValueError(f"run {run} is {found and found['status']}, not {' or '.join(allowed)}")
        return found

    def bootstrap(self) -> list[str]:
        """Create the tables that aren't there, empty and in their layouts; their names."""
        have = self.store.manifest()["tables"]
        kinds = {"raw": (RAW, RAW_LAYOUT)}
        for n, e in self.entities.items():
            kinds |= {f"staging_{n}": (f"{e.schema}, execucao string", Layout(("execucao",), (e.key,))), n: (e.schema, e.layout)}
        new = {n: k for n, k in kinds.items() if n not in have}
        if new:
            self.store.commit(replaced={n: self.spark.createDataFrame([], schema) for n, (schema, _) in new.items()}, layouts={n: layout for n, (_, layout) in new.items()})
        return sorted(new)

    def status(self, run: str) -> str:
        return self._run(run)["status"]

    def watermarks(self) -> dict[str, str]:
        return {k.removeprefix("mark:"): v for k, v in self._state().items() if k.startswith("mark:")}

    def begin(self, run: str, end: str) -> dict:
        """Opens or resumes a run; its windows [watermark - 5 minutes, end) are frozen when it is opened."""
        until = _instant(end)
        found = self._state().get(f"run:{run}")
        if found:
            if _instant(found["end"]) != until:
                raise ValueError(f"run {run} was opened with another end")
            return found
        marks = self.watermarks()
        if any(until < _instant(m) for m in marks.values()):
            raise ValueError("the end lies before a watermark")
        limits = {e: ((_instant(marks[e]) - LOOKBACK).isoformat() if e in marks else EPOCH) for e in self.entities}
        found = {"end": until.isoformat(), "limits": limits, "status": "iniciada", "error": None}
        self.store.commit(state={f"run:{run}": self._stamped(found)})
        return found

    def window(self, run: str, entity: str) -> tuple[datetime, datetime]:
        found = self._run(run)
        return _instant(found["limits"][entity]), _instant(found["end"])

    def add_raw(self, run: str, entity: str, records: DataFrame) -> None:
        """records: payload. Rows outside the run's window are an error; rows known to the run are passed over; one
        version of a key with two payloads is an error."""
        self._run(run, "iniciada", "falha", "preparada")
        key = self.entities[entity].key
        get = lambda c: F.get_json_object("payload", f"$.{c}")
        rows = records.select(F.lit(run).alias("execucao"), F.lit(entity).alias("entidade"), get(key).alias("chave"), get("atualizado_em").try_cast("timestamp").alias("versao"), "payload")
        low, high = self.window(run, entity)
        if not rows.where(~F.coalesce((F.col("versao") >= F.lit(low)) & (F.col("versao") < F.lit(high)), F.lit(False))).isEmpty():
            raise ValueError(f"{entity}: a row lies outside the window")
        old = self.raw(run, entity)
        both = old.unionByName(rows)
        if not changes.conflicts(both, ["execucao", "entidade", "chave", "versao"], ["payload"]).isEmpty():
            raise ValueError(f"{entity}: one version has different contents")
        with stage_event(run, "raw", entity) as event:
            self._counted(event, "raw", appended={"raw": changes.insert_only(old, rows, ["execucao", "entidade", "chave", "versao"])}, layouts={"raw": RAW_LAYOUT})

    def _counted(self, event: dict, name: str, **what) -> None:
        counted: dict[str, int] = {}
        self.store.commit(**what, counted=counted)
        event["registros"] = counted.get(name, sum(counted.values()))

    def raw(self, run: str, entity: str) -> DataFrame:
        return self.store.read("raw", RAW, where={"execucao": [run], "entidade": [entity]})

    def published(self, entity: str, months: set[str] | None = None) -> DataFrame:
        """An entity's table, or what it holds in the given months (yyyy-MM) of its date."""
        return self.store.read(entity, self.entities[entity].schema, where=None if months is None else {"mes": months})

    def stage(self, run: str) -> None:
        """The newest version of each key, then typed: an invalid older payload that was corrected does no harm."""
        self._run(run, "iniciada", "preparada", "falha")
        frames = {}
        for name, e in self.entities.items():
            newest = changes.latest(self.raw(run, name), ["chave"], [F.desc("versao"), F.asc("payload")])
            typed = e.typed(newest.select(*registry.fields(e)))
            bad = typed.where(F.size("errors") > 0).limit(20).collect()
            if bad:
                raise ValueError("; ".join(f"{name}/{r[e.key]}: {', '.join(r.errors)}" for r in bad))
            frames[f"staging_{name}"] = typed.drop("errors").withColumn("execucao", F.lit(run))
        with stage_event(run, "staging") as event:  # other runs' partitions keep their files
            by_run = {n: Layout(("execucao",), (self.entities[n.removeprefix("staging_")].key,)) for n in frames}
            self._counted(event, "", overwritten=frames, emptied={n: [{"execucao": run}] for n in frames}, layouts=by_run, state={f"run:{run}": self._stamped(self._run(run) | {"status": "preparada"})})

    def staged(self, run: str, entity: str) -> DataFrame:
        """A run's staged rows; those of other runs stay as they are."""
        e = self.entities[entity]
        return self.store.read(f"staging_{entity}", f"{e.schema}, execucao string", where={"execucao": [run]}).drop("execucao")

    def candidate(self, run: str, entity: str) -> DataFrame:
        """What a run would publish: its staged rows over the published ones."""
        return changes.upsert(self.published(entity), self.staged(run, entity), [self.entities[entity].key], "atualizado_em")

    def violations(self, run: str) -> DataFrame:
        """All rules over a run's candidate state, as (entity, key, rule)."""
        c = {n: self.candidate(run, n) for n in self.entities}
        sale = c["vendas"].select("id_lancamento", "data_venda", F.col("quantidade").alias("_q"), F.col("valor_liquido").alias("_v"), F.col("cancelado").alias("_c"))
        told = [checked([self._declared(e) for e in self.entities.values()], c | {"devolucoes": c["devolucoes"].join(sale, "id_lancamento", "left")}).select("entity", "key", "rule")]
        for n, e in self.entities.items():
            staged = self.staged(run, n)
            same = self.published(n).join(staged, [e.key, "atualizado_em"]).select(e.key)
            both = self.published(n).unionByName(staged)
            told.append(changes.conflicts(both, [e.key, "atualizado_em"], [*e.columns]).join(same, e.key, "left_semi").select(F.lit(n).alias("entity"), F.col(e.key).cast("string").alias("key"), F.lit("alteração sem atualizar timestamp").alias("rule")))
        total = c["devolucoes"].groupBy("id_lancamento").agg(F.sum("quantidade").alias("_rq"), F.sum("valor_devolvido").alias("_rv")).join(sale, "id_lancamento")
        told.append(quality.holds(total, "devolucoes", (F.col("_rq") <= F.col("_q")) & (F.col("_rv") <= F.col("_v")), "acumulado superior à venda", "id_lancamento"))
        return quality.all_of(*told)

    @staticmethod
    def _declared(e: Entity) -> Declared:
        """What holds for an entity's rows by themselves, its references included: one scan of its candidate state."""
        own = {"chave não positiva": f"{e.key} > 0"} | RULES.get(e.name, {})
        goals = {"unique": (("id_vendedor", "competencia"),)} if e.name == "metas" else {}
        told = {f"related {x}": f"{x} sem dimensão" for x in e.refers} | {"unique id_vendedor, competencia": "Mais de uma meta para vendedor e competência"}
        return Declared(e.name, e.key, refers={x: (parent, ENTITIES[parent].key) for x, parent in e.refers.items()}, holds=own, told=told, **goals)

    def approve(self, run: str) -> dict:
        self._run(run, "preparada", "aprovada")
        quality.gate(self.violations(run))
        self.store.commit(state={f"run:{run}": self._stamped(self._run(run) | {"status": "aprovada"})})
        return {"regras": "aprovadas"}

    def publish(self, run: str, fail_after: int | None = None) -> None:
        """All tables, watermarks and the run's state in one version; again after success it does nothing."""
        found = self._run(run)
        if found["status"] == "sucesso":
            return
        self._run(run, "aprovada")
        whole, some, emptied = {}, {}, {}
        for n, e in self.entities.items():
            months = self._touched(run, e) if e.month else None
            if not months:
                if e.month is None or n not in self.store.manifest()["tables"]:
                    whole[n] = self.candidate(run, n).select(*e.columns, "atualizado_em")
            else:
                some[n] = changes.upsert(self.published(n, months), self.staged(run, n), [e.key], "atualizado_em").select(*e.columns, "atualizado_em")
                emptied[n] = [{"mes": m} for m in months]
        marks = self.watermarks()
        later = {f"mark:{e}": max(found["end"], marks.get(e, found["end"]), key=_instant) for e in self.entities}
        with stage_event(run, "publicacao") as event:
            self._counted(event, "", replaced=whole, overwritten=some, emptied=emptied, layouts={n: e.layout for n, e in self.entities.items()}, state=later | {f"run:{run}": self._stamped(found | {"status": "sucesso"})}, fail_after=fail_after)

    def _touched(self, run: str, e: Entity) -> set[str]:
        """The months that a run's rows are in, and those that their published versions are in: at most the table's partitions."""
        month = F.date_format(e.month, "yyyy-MM").alias("mes")
        staged = self.staged(run, e.name)
        before = self.published(e.name).select(e.key, month).join(staged.select(e.key), e.key, "left_semi").select("mes")
        return {r.mes for r in staged.select(month).unionByName(before).distinct().collect()}

    @staticmethod
    def _stamped(found: dict) -> dict:
        return found | {"updated": datetime.now(timezone.utc).isoformat()}

    def fail(self, run: str, error: str) -> None:
        """Marks a run as failed; a success stays one."""
        found = self._run(run)
        if found["status"] != "sucesso":
            self.store.commit(state={f"run:{run}": self._stamped(found | {"status": "falha", "error": error[:2000]})})

    def execute(self, run: str, end: str, extract: Source, after: Callable[[], object] | None = None) -> None:
        """The whole run. extract(entity, low, high) gives a DataFrame of payloads. The first error is what is raised.
        after: what follows a success, as a second publication; its failure doesn't undo the run."""
        self.begin(run, end)
        try:
            if self._run(run)["status"] == "sucesso":
                return
            for e in self.entities:
                self.add_raw(run, e, extract(e, *self.window(run, e)))
            self.stage(run)
            self.approve(run)
            self.publish(run)
            if after is not None:
                after()
        except Exception as e:
            try:
                self.fail(run, str(e))
            except Exception as second:
                e.add_note(f"the failure couldn't be recorded: {second}")
            raise

    def failures(self, pattern: str) -> DataFrame:
        """id, erro of the failed runs whose message is LIKE the pattern."""
        failed = [(k.removeprefix("run:"), v["error"]) for k, v in self._state().items() if k.startswith("run:") and v["status"] == "falha"]
        return self.spark.createDataFrame(failed, "id string, erro string").where(F.col("erro").like(pattern))

    def fingerprint(self) -> dict[str, str]:
        """A signature of each published table, and the watermarks: equal before and after a run that failed."""
        tables = self.store.manifest()["tables"]
        return {n: signature(self.published(n)) for n in self.entities if n in tables} | {f"mark:{k}": v for k, v in self.watermarks().items()}

    def monitor(self) -> dict[str, DataFrame]:
        """The last 30 runs; the lag of each watermark in hours; raw rows against versions."""
        runs = [(k.removeprefix("run:"), v["status"], v["end"], v.get("updated"), v["error"]) for k, v in self._state().items() if k.startswith("run:")]
        latest = self.spark.createDataFrame(runs, "id string, status string, fim string, atualizado_em string, erro string").orderBy(F.desc("atualizado_em"), "id").limit(30)
        marks = self.spark.createDataFrame(list(self.watermarks().items()), "entidade string, valor string").withColumn("valor", F.col("valor").cast("timestamp"))
        marks = lag_hours(marks, self.spark.range(1).select(F.current_timestamp().alias("agora")))
        raw = self.store.read("raw", RAW).groupBy("execucao", "entidade").agg(F.count(F.lit(1)).alias("linhas_raw"), F.count_distinct(F.concat_ws("|", "chave", F.col("versao").cast("string"))).alias("versoes"))
        return {"execucoes": latest, "marcas": marks, "raw": raw}
