"""Values that independent implementations publish for short series."""

import numpy as np
import pytest

from seriesmill.kernels import arma, panel, stl
from seriesmill.params import ArimaOptions, StlOptions

# Twelve points and their 22 features, to 14 places.
SHORT = [-0.89094, -0.86099, -0.82438, -0.78214, -0.73573, -0.68691, -0.63754, -0.58937, -0.54342, -0.50044, -0.46082, -0.42469]
SHORT_FEATURES = {
    "DN_OutlierInclude_n_001_mdrmd": -0.58333333333333,
    "DN_OutlierInclude_p_001_mdrmd": 0.75,
    "DN_HistogramMode_5": 0.02269949495805,
    "DN_HistogramMode_10": 0.02269949495805,
    "CO_Embed2_Dist_tau_d_expfit_meandiff": 0.51152503131790,
    "CO_f1ecac": 2.67524184613158,
    "CO_FirstMin_ac": 8.0,
    "CO_HistogramAMI_even_2_5": 1.36615884756920,
    "CO_trev_1_num": 0.01964378196445,
    "FC_LocalSimple_mean1_tauresrat": 0.6,
    "FC_LocalSimple_mean3_stderr": 0.05070841167817,
    "IN_AutoMutualInfoStats_40_gaussian_fmmi": 6.0,
    "MD_hrv_classic_pnn40": 1.0,
    "SB_BinaryStats_diff_longstretch0": 1.0,
    "SB_BinaryStats_mean_longstretch1": 5.0,
    "SB_MotifThree_quantile_hh": 1.49903067297901,
    "SC_FluctAnal_2_rsrangefit_50_1_logi_prop_r1": 0.0,
    "SC_FluctAnal_2_dfa_50_1_2_logi_prop_r1": 0.0,
    "SP_Summaries_welch_rect_area_5_1": 0.0,
    "SP_Summaries_welch_rect_centroid": 0.39269908169875,
    "SB_TransitionMatrix_3ac_sumdiagcov": 0.16666666666667,
    "PD_PeriodicityWang_th0_01": 0.0,
}

# Forty points; coefficients of an AR(1) and of an IMA(1, 1).
TREND = [
    0.0, 0.5, 0.3, 0.8, 0.4, 1.1, 0.6, 1.3, 0.9, 1.5,
    1.2, 1.7, 1.4, 1.9, 1.6, 2.1, 1.8, 2.3, 2.0, 2.4,
    2.2, 2.5, 2.4, 2.7, 2.6, 2.9, 2.8, 3.0, 2.9, 3.2,
    3.1, 3.3, 3.2, 3.4, 3.3, 3.5, 3.4, 3.6, 3.5, 3.7,
]
AR1, IMA1 = 0.9719, -0.4145

# A quarterly series and its parts by STL with a seasonal window of 7.
QUARTERLY = [
    11.866483839552, 12.102002026312, 12.813169339156, 6.907145645957, 12.27099235763, 12.426567239735, 11.557846481083, 7.919025875789,
    13.433047147155, 13.433825796146, 14.464606727616, 7.795387631966, 14.693308303008, 13.703505469268, 15.740267443564, 8.813875156708,
    15.586571681166, 15.997977481822, 16.034467160292, 10.798373800977, 17.348930470126, 17.420811009674, 16.830999854758, 11.680600940843,
    17.346516250567, 17.991910377324, 18.869022292204, 11.959074265342, 17.48174523419, 18.819484807138, 19.027224570454, 12.754982090858,
]
QUARTERLY_TREND = [
    10.916257, 10.938638, 10.952229, 10.965786, 10.963609, 11.032668, 11.239132, 11.522692,
    11.880445, 12.227101, 12.449011, 12.633082, 12.868818, 13.100688, 13.39111, 13.729349,
    14.060221, 14.402891, 14.825741, 15.188985, 15.430362, 15.667758, 15.841986, 15.979419,
    16.196529, 16.420814, 16.562262, 16.690606, 16.822516, 16.950084, 17.080541, 17.217989,
]
QUARTERLY_SEASONAL = [
    1.119755, 1.260776, 1.386956, -3.916487, 1.306037, 1.219265, 1.491193, -4.153909,
    1.476644, 1.206425, 1.534946, -4.352949, 1.631601, 1.204044, 1.631985, -4.569819,
    1.664225, 1.337245, 1.637008, -4.575544, 1.419835, 1.521319, 1.710516, -4.556561,
    1.151617, 1.708101, 1.774994, -4.530508, 0.861336, 1.878762, 1.902293, -4.522908,
]


@pytest.mark.parametrize("name", SHORT_FEATURES)
def test_features_of_a_short_series(name):
    assert panel.feature(np.array(SHORT), name) == pytest.approx(SHORT_FEATURES[name], rel=1e-6, abs=1e-6)


def test_coefficients_of_a_trending_series():
    y = np.array(TREND)
    one = arma.fit_arima(y, ArimaOptions((1, 0, 0)))
    two = arma.fit_arima(y, ArimaOptions((0, 1, 1), constant=False))
    assert one.phi[0] == pytest.approx(AR1, abs=0.15) and two.theta[0] == pytest.approx(IMA1, abs=0.2)
    assert two.aic < one.aic and 0 < two.sigma2 < one.sigma2 < 1
    assert arma.forecast(two, 5)[0][0] > y[-1] - 0.5


def test_stl_of_a_quarterly_series():
    trend, seasonal, residual = (x[0] for x in stl.stl_rows([np.array(QUARTERLY)], StlOptions(4)))
    assert np.abs(trend - QUARTERLY_TREND).max() < 0.2 and np.abs(seasonal - QUARTERLY_SEASONAL).max() < 0.2
    assert np.allclose(trend + seasonal + residual, QUARTERLY)
