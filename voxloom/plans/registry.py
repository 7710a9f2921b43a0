"""All queries over the reference tables, with their SQL."""

from voxloom.plans import file_queries as _files
from voxloom.plans import object_queries as _objects
from voxloom.plans import region_queries as _regions
from voxloom.plans import state_queries as _states
from voxloom.plans import volume_queries as _volumes
from voxloom.plans import workflow_queries as _workflows

QUERIES: dict = {**_volumes.QUERIES, **_objects.QUERIES, **_workflows.QUERIES, **_states.QUERIES, **_files.QUERIES, **_regions.QUERIES}
ORACLES: dict = {**_volumes.ORACLES, **_objects.ORACLES, **_workflows.ORACLES, **_states.ORACLES, **_files.ORACLES, **_regions.ORACLES}


def flagship(spark, sf_dir: str):
    """Threshold and connected components with their statistics: the object table of a volume."""
    return QUERIES["cc26_stats"](spark, sf_dir)
