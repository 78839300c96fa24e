"""A view of the fleet tables over one test-data directory.

Each accessor returns a lazy plan over the Parquet tables, built once per
``Fleet`` (one ``Fleet`` per query), so a query that uses the inspections in
several branches carries one plan for them and Spark can reuse its
exchanges. Nothing is cached in memory or collected.

Aggregates per driver or vehicle run on ``visits``: the orders alone, keyed by
numbers, or a stored inspection table, keyed by names and plates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fleet
from ..sources import tables


@dataclass
class Fleet:
    spark: SparkSession
    sf_dir: str
    # D3: the day the status of drivers and vehicles is of.
    as_of: str
    # A stored inspection table (``tables.write_inspections``); when set it is
    # read instead of deriving the inspections from the test tables.
    inspections_path: str | None = None
    _plans: dict = field(default_factory=dict, repr=False)

    def _once(self, key, build):
        if key not in self._plans:
            self._plans[key] = build()
        return self._plans[key]

    @property
    def driver_key(self) -> str:
        return "conductor" if self.inspections_path else "conductor_id"

    @property
    def vehicle_key(self) -> str:
        return "placa" if self.inspections_path else "vehiculo_id"

    # --- base tables -----------------------------------------------------------
    def conductores(self) -> DataFrame:
        return self._once("conductores", lambda: tables.conductores(self.spark, self.sf_dir))

    def vehiculos(self) -> DataFrame:
        return self._once("vehiculos", lambda: tables.vehiculos(self.spark, self.sf_dir))

    def inspecciones(self) -> DataFrame:
        if self.inspections_path:
            return self._once("inspecciones", lambda: tables.read_inspections(self.spark, self.inspections_path))
        return self._once("inspecciones", lambda: tables.inspecciones(self.spark, self.sf_dir))

    def visits(self) -> DataFrame:
        if self.inspections_path:
            return self.inspecciones()
        return self._once("visits", lambda: tables.visits(self.spark, self.sf_dir))

    def evaluaciones(self) -> DataFrame:
        return self._once("evaluaciones", lambda: tables.evaluaciones(self.spark, self.sf_dir))

    def inspecciones_raw(self) -> DataFrame:
        return self._once("inspecciones_raw", lambda: tables.inspecciones_raw(self.spark, self.sf_dir))

    def upload(self) -> DataFrame:
        return self._once("upload", lambda: tables.upload_from_raw(self.inspecciones_raw()))

    def stored(self, mode: str) -> DataFrame:
        return self._once(("stored", mode), lambda: tables.stored_from_raw(self.inspecciones_raw(), mode))

    # --- per driver and per vehicle ------------------------------------------------
    def latest(self) -> DataFrame:
        """(driver key, inspeccion_id, placa, fecha) of each driver's latest inspection."""

        def build() -> DataFrame:
            found = fleet.latest_inspection_per_driver(self.visits(), self.driver_key, self.vehicle_key)
            plate = F.col("placa") if self.inspections_path else tables.plate_of(F.col("vehiculo_id"))
            return found.select(self.driver_key, "inspeccion_id", plate.alias("placa"), "fecha")

        return self._once("latest", build)

    def latest_named(self) -> DataFrame:
        """The same with the driver's name."""
        found = self.latest()
        if not self.inspections_path:
            found = found.join(tables.names(self.spark, self.sf_dir), self.driver_key)
        return found.select("conductor", "inspeccion_id", "placa", "fecha")

    def vehicle_summary(self) -> DataFrame:
        return self._once("vehicle_summary", lambda: fleet.vehicle_summary(self.visits(), self.vehicle_key))

    def latest_evaluations(self) -> DataFrame:
        """(driver key, …) of each driver's latest evaluation."""
        if self.inspections_path:
            return self._once("latest_eval", lambda: fleet.latest_evaluation_per_driver(self.evaluaciones()))
        events = tables.fatigue_events(self.spark, self.sf_dir)
        return self._once("latest_eval", lambda: fleet.latest_evaluation_per_driver(events, "conductor_id"))

    def latest_evaluations_named(self) -> DataFrame:
        found = self.latest_evaluations()
        if not self.inspections_path:
            found = found.join(tables.names(self.spark, self.sf_dir), self.driver_key)
        return found.select("conductor", "evaluacion_id", "fecha_evaluacion", "score_fatiga")

    # --- status tables -----------------------------------------------------------
    def drivers(self) -> DataFrame:
        return self._once(
            "drivers", lambda: fleet.driver_status(self.conductores(), self.latest(), self.as_of, key=self.driver_key)
        )

    def vehicles(self, with_result: bool = False) -> DataFrame:
        return self._once(
            ("vehicles", with_result),
            lambda: fleet.vehicle_status(
                self.vehiculos(), self.vehicle_summary(), self.as_of, with_result=with_result, key=self.vehicle_key
            ),
        )

    def fatigue_levels(self) -> DataFrame:
        names = tables.names(self.spark, self.sf_dir)
        return self._once(
            "levels", lambda: fleet.fatigue_levels(self.latest_evaluations(), names, self.driver_key)
        )

    def fatigue(self) -> DataFrame:
        return self._once("fatigue", lambda: fleet.fatigue_status(self.fatigue_levels(), self.latest(), self.driver_key))
