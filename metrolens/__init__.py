"""metrolens: rail-transit passenger-flow analytics and forecasting on Spark.

Every public function takes DataFrames (usually bundled in
:class:`metrolens.plans.inputs.Inputs`) and returns a lazy DataFrame.
Nothing is collected to the driver; the caller decides when to act.
"""

import sys

from pyspark import cloudpickle

from metrolens.plans.inputs import Inputs
from metrolens.plans import descriptive, forecast
from metrolens.session import get_session

__all__ = ["Inputs", "descriptive", "forecast", "get_session"]

# Python steps travel to the workers by value: executors need not have this
# package installed, and a job may be started from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
