"""Rings whose matches and metrics are known (closing vertices left out)."""

REFERENCES = [
    [(34.96699221536898, 132.38460553989236), (43.124711758343956, 132.5581740408067), (43.34171165337849, 122.35917897418234), (35.18399211040352, 122.18561047326807)],
    [(62.043678358009316, 113.81277594205571), (73.49919941835716, 112.0770909329121), (72.70536502683233, 106.83778394884817), (61.24984396648446, 108.57346895799174)],
    [(25.41697834833667, 104.87422940931174), (59.26658234337954, 105.48148789816638), (59.09226556499047, 115.19819672391053), (76.11287412889969, 115.50354472849631), (75.72585480552048, 137.07664922231027), (46.899459488153425, 136.5595065915686), (47.25615961337678, 116.67644492114238), (30.991053551372985, 116.38465055540269), (30.628837504056737, 136.5751789503696), (24.850126324475298, 136.47150945341014)],
    [(9.625991081872252, 131.16962603349182), (17.263005122104143, 135.33527005543647), (22.058802300234696, 126.54297522886377), (14.421788260002813, 122.37733120691912)],
    [(42.777574756515236, 95.93522034787651), (57.70446583515029, 96.62949435153396), (58.18892146749196, 86.2136982561885), (43.262030388856886, 85.51942425253117)],
]

TARGETS = [
    [(61.4904136327321, 112.76613867226783), (73.06928087129809, 113.18014191706459), (73.25862975210954, 107.88442121863608), (61.67976251354354, 107.47041797383926)],
    [(26.486620299751593, 100.56575307602654), (60.109724526024024, 104.52192745068817), (58.974083634387995, 114.1736183133695), (75.88080123801828, 116.16290289854646), (73.35944343445809, 137.59165405870766), (44.72593580566861, 134.22256748135385), (45.47875178384629, 127.73731582065088), (42.05867872101621, 127.06395302995114), (43.04441155090723, 119.60054731791911), (46.377127309110186, 120.02300424501524), (47.04976975899588, 114.47255046549608), (30.89349932067057, 112.57156527780892), (28.533730176584186, 132.62699164873197), (22.79368641379608, 131.951604453934)],
]
